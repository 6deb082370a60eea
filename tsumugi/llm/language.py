"""Language identification by rank-order profiles (operator 12).

A profile is the list of the most frequent n-grams, of one to three characters within words that are marked at both ends.
A language's profile is counted over all its learning texts; a document's is compared with each by the out-of-place
distance: how far each of its n-grams is from its place in the language's list, or the length of a list if it isn't there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import giving_way, rows_of, unused

#: N-grams of a profile; characters of a text looked at together; n-grams counted before they are handed on; languages at most.
PLACES, STEP, MANY, MOST_LANGUAGES = 400, 1 << 20, 1 << 20, 8192
#: The mark between words, and the bits of a character within an n-gram.
MARK, BITS = 0x5F, 21
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: those whose CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@cache
def kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark that goes with letters, 0 for anything else."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def marked(text: str) -> np.ndarray | None:
    """The lower-cased words' code points with one mark before, between and behind them; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = kinds()[points]
    if not (kind == 2).any():
        return None
    inside = kind > 0
    out = np.concatenate([[MARK], np.where(inside, points, MARK), [MARK]])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != MARK) | (out[:-1] != MARK)
    return out[keep]


def counted(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams in order, and how often each occurs."""
    if counts is None:
        return np.unique(grams, return_counts=True)
    distinct, at = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def gram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of marked words with their counts: a mark stands at an n-gram's end only. Long texts are counted by steps."""
    found: tuple[np.ndarray, np.ndarray] | None = None
    for start in range(0, len(points), STEP):
        one = points[start : start + STEP + 2]
        own = one[:STEP]
        grams = [own[own != MARK]]
        two, after = (one[:-1] << BITS | one[1:])[:STEP], one[1:][:STEP]
        grams.append(two)
        if len(one) > 2:
            n = min(STEP, len(one) - 2)
            grams.append((two[:n] << BITS | one[2 : n + 2])[after[:n] != MARK])
        now = counted(np.concatenate(grams))
        found = now if found is None else counted(np.concatenate([found[0], now[0]]), np.concatenate([found[1], now[1]]))
    return found


def top(grams: np.ndarray, counts: np.ndarray, places: int) -> np.ndarray:
    """The most frequent n-grams in the order of their places; equally frequent ones by their value."""
    if len(counts) > 4 * places:  # all that could be among the first
        least = np.partition(counts, len(counts) - places)[len(counts) - places]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:places]


def gram_text(gram: int) -> str:
    """An n-gram as text, with an underscore for the mark."""
    return "".join(chr(gram >> shift & (1 << BITS) - 1) for shift in (2 * BITS, BITS, 0) if gram >> shift)


class Profiles(NamedTuple):
    """All languages' lists: for each n-gram, in order, the run of the languages that list it and its place in each."""

    languages: list[str]
    grams: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    place: np.ndarray
    places: int

    def distances(self, own: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a document's list from each language's."""
        most = float(len(own) * self.places)
        if not len(self.grams):
            return np.full(len(self.languages), most)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        place = np.flatnonzero(self.grams[at] == own)
        begin, size = self.starts[at[place]], self.starts[at[place] + 1] - self.starts[at[place]]
        listed = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        nearer = self.places - np.abs(self.place[listed] - np.repeat(place, size))
        return most - np.bincount(self.language[listed], nearer, len(self.languages))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language of the least distance (of equal ones the first by code points), and 1 less its share of the greatest possible.

        UNKNOWN and 0 for a text without letters, and where nothing has been learnt.
        """
        points = marked(text) if text else None
        if points is None or not self.languages:
            return UNKNOWN, 0.0
        own = top(*gram_counts(points), self.places)
        d = self.distances(own)
        best = int(d.argmin())
        return self.languages[best], 1.0 - float(d[best]) / (len(own) * self.places)


def profiles_of(rows: list[tuple[str, int, int]], places: int) -> Profiles:
    """Profiles from (language, n-gram, place from 0)."""
    languages = sorted({r[0] for r in rows})
    number = {name: k for k, name in enumerate(languages)}
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    grams, starts = np.unique(np.array([r[1] for r in rows], np.int64), return_index=True)
    return Profiles(languages, grams, np.append(starts, len(rows)), np.array([number[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), places)


def learning_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and count over all texts of a language; each task adds up what it can hold before it hands it on."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(grams), np.int32))), pa.array(grams), pa.array(n.astype(np.int64))], schema=schema)

        for texts, langs in rows_of(batches, ["text", "lang"]):
            for text, lang in zip(texts, langs, strict=True):
                points = marked(text)
                if points is not None:
                    grams, n = gram_counts(points)
                    held.setdefault(lang, []).append((grams, n))
                    size += len(grams)
            if size > MANY:
                for lang, parts in held.items():
                    held[lang] = [counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > MANY // 2:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    return docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, places: int = PLACES) -> Profiles:
    """The profiles of all values of lang, from every text with one; rows with neither text nor lang teach nothing.

    Counts cover all texts. What comes to the driver is places rows a language; more than MOST_LANGUAGES languages (there are
    fewer in the world) are an error, since lang then isn't one.
    """
    ranked = learning_counts(docs).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("place") < places)
    rows = ranked.select("lang", "gram", "place").limit(MOST_LANGUAGES * places + 1).collect()
    if len(rows) > MOST_LANGUAGES * places or len({r[0] for r in rows}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    return profiles_of([tuple(r) for r in rows], places)


def identify(docs: DataFrame, profiles: Profiles, keys: list[str]) -> DataFrame:
    """keys, lang_pred and score of every row, by its whole text; one pass, no shuffle.

    Null texts and texts without letters are UNKNOWN with a score of 0. A key named like a result gives way; other columns
    aren't read. Repeated rows give repeated results, an empty table none.
    """
    keys = giving_way(keys, ["lang_pred", "score"])
    text = unused("_text", keys)
    one = docs.select(*[docs[k] for k in keys], docs["text"].alias(text))
    schema = T.StructType([*one.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            out = [own.nearest(t) for (texts,) in rows_of(iter([batch]), [text]) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=schema.names)

    return one.mapInArrow(kernel, schema)
