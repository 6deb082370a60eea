"""Chat formatting (operator 10): typed content parts, flattened by a visitor into text with ordered placeholders.

A turn becomes ``<|im_start|>role\\n`` + content + ``<|im_end|>\\n``. Inside roles and texts, every ``<`` that some
backslashes (or none) and a ``|`` follow gets one more backslash, so no control string can stem from a text, and removing
one backslash restores it. An attachment becomes ``<|image|>``, ``<|audio|>`` or ``<|document|>``; its reference, the
place of its placeholder and the number of tokens that it will expand to are recorded beside the text. A line end inside a
role becomes ``<|newline|>``, since the role ends at the first. What a part lacks, or
has in a form that means nothing, counts as the least there can be and is counted as an error; no part ends the job.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import giving_way, shuffle_partitions, unused

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|newline|>"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURN = T.StructType(
    [
        T.StructField("formatted", T.StringType()),
        T.StructField("mask_start", T.LongType()),
        T.StructField("mask_end", T.LongType()),
        T.StructField("n_errors", T.LongType()),
        T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())]))),
    ]
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class Attachment(NamedTuple):
    kind: str
    ref: str | None
    offset: int
    n_tokens: int


class Flattener:
    """Visits a turn's parts in order. Images expand by patches, audio by seconds, documents by pages.

    A part of another type becomes the placeholder <|unknown|> of one token, and is an error; so is a null part, which leaves
    nothing. A size that is missing counts as 0; one that is negative or no number does so too, and is an error. An
    attachment has one token (or page) at least.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.attachments: list[Attachment] = []
        self.length = self.n_errors = 0
        self.visitors = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}

    def visit(self, part: dict | None) -> None:
        if part is None:
            self.n_errors += 1
        else:
            self.visitors.get(part.get("type") or "text", self.visit_unknown)(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def size(self, value: float | None) -> float:
        """value as a size: 0 for none, and for what can't be one."""
        if value is None:
            return 0
        if not math.isfinite(value) or value < 0:
            self.n_errors += 1
            return 0
        return value

    def visit_text(self, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil(self.size(part.get(side)) / self.patch)) for side in ("width", "height"))
        self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil(min(self.size(part.get("seconds")) * self.audio_rate, 2.0**62))))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, int(self.size(part.get("pages")))) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        self.n_errors += 1
        self.attach("unknown", part, 1)

    def attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.attachments.append(Attachment(kind, part.get("ref"), self.length, n_tokens))
        self.put(f"<|{kind}|>")


def joined(parts: list[dict | None]) -> list[dict | None]:
    """Neighbouring text parts become one, so that no control string can arise where two meet; null parts come last."""
    out: list[dict] = []
    for p in parts:
        if p is None:
            continue
        if out and (p.get("type") or "text") == "text" == (out[-1].get("type") or "text"):
            out[-1] = {"type": "text", "text": (out[-1].get("text") or "") + (p.get("text") or "")}
        else:
            out.append(p)
    return [*out, *[None] * sum(p is None for p in parts)]


def format_turn(role: str | None, content: str | list[dict] | None, trained: tuple[str, ...] = ("assistant",)) -> tuple[str, int, int, int, list[Attachment]]:
    """The turn's text, the span of it under the loss mask (empty unless the role is trained), its errors and attachments."""
    role = role or ""
    head = START + escape(role).replace("\n", NEWLINE) + "\n"
    flat = Flattener()
    for part in joined([{"type": "text", "text": content}] if content is None or isinstance(content, str) else content):
        flat.visit(part)
    body = "".join(flat.out)
    begin = len(head)
    found = [a._replace(offset=a.offset + begin) for a in flat.attachments]
    return head + body + END, begin, begin + len(body) if role in trained else begin, flat.n_errors, found


def format_turns(rows: DataFrame, keys: list[str], role: str = "role", content: str = "text") -> DataFrame:
    """keys and the formatted text, mask span, errors and attachments of each row; a conversation is its rows' texts in order.

    content is a string (one text part) or an array of typed parts (see PARTS). Null roles, texts and contents count as
    empty; for odd parts, see Flattener. Turns of any length are formatted whole, each on its own: no shuffle. Repeated rows
    give repeated results, an empty table none; other columns aren't read. A key named like a result gives way.
    """
    keys = giving_way(keys, TURN.names)
    one = rows.select(*[rows[k].alias(k) for k in keys], rows[role].alias(unused("_role", keys)), rows[content].alias(unused("_content", keys)))
    schema = T.StructType([*one.schema.fields[:-2], *TURN.fields])
    names = [f.name for f in schema.fields]
    found = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turn(r, c) for r, c in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            made = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([[a._asdict() for a in x[4]] for x in out], found)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=names)

    return one.mapInArrow(kernel, schema)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text (placeholders included) of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    head, _, rest = formatted[len(START) : -len(END)].partition("\n")
    return unescape(head.replace(NEWLINE, "\n")), unescape(rest)


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, read back from format_turns() over the keys conv_id and turn.

    A conversation's turns are taken by turn (nulls first), equal turns by their formatted text; a row without a conv_id
    is a conversation of its own. The turns stream past in order, so a conversation of any length takes the same memory.
    """
    n = shuffle_partitions(turns.sparkSession)
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("formatted"))
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "formatted", "mask_start", "mask_end").repartition(n, "conv_id", alone).sortWithinPartitions("conv_id", "turn", "formatted")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None

        def ended() -> dict:
            conv, n_turns, text, chars, loss, length = now
            return {"conv_id": conv, "n_turns": n_turns, "turns_sha256": text.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}

        for batch in batches:
            out = []
            for conv, _, formatted, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv is None or now[0] != conv:
                    if now is not None:
                        out.append(ended())
                    now = (conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                role, text = read_turn(formatted)
                under = unescape(formatted[start:end])
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[4].update(under.encode("utf-8", "surrogatepass"))
                now = (conv, now[1] + 1, now[2], now[3] + len(under), now[4], now[5] + len(formatted))
            yield pa.RecordBatch.from_pylist(out, schema=DIGEST_ARROW)
        if now is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=DIGEST_ARROW)

    return ordered.mapInArrow(kernel, DIGEST)
