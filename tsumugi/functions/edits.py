"""Column functions that decode and apply character tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow, batch
from tsumugi import vocab
from tsumugi.kernels import edits, norm, norm_batch


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def typo_tags(tokens: Column | str, probabilities: Column | str, threshold: float, kind: str) -> Column:
    """Tags of predicted tokens: below the threshold (strictly) nothing is edited. kind is R (replace) or I (insert)."""
    idle = "K" if kind == "R" else "_"
    tag = lambda t: F.when(t == "<k>", "K").when(t == "<d>", "D").when(t == "<_>", "_").otherwise(F.concat(F.lit(f"{kind}:"), t))
    return F.zip_with(_col(tokens), _col(probabilities), lambda t, p: F.when(p < threshold, F.lit(idle)).otherwise(tag(t)))


def characters(text: Column | str) -> Column:
    """Code points of a text; an empty text has none."""
    text = _col(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def split_characters(text: pa.Array) -> pa.Array:
    """The code points of all texts, one after the other: a view of the same bytes, cut before each that begins one."""
    text = text.cast(pa.string())
    _, places, data = text.buffers()
    ends = np.frombuffer(places, np.int32)[text.offset : text.offset + len(text) + 1]
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    begin = np.flatnonzero((own & 0xC0) != 0x80)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.r_[begin, len(own)].astype(np.int32)), pa.py_buffer(own.tobytes()))


@batch("string")
def apply_edits(text: pa.Array, keep_tags: pa.Array, insert_tags: pa.Array) -> pa.Array:
    """A text under its edit tags: before each character what is inserted there, then the character kept, replaced or dropped.

    There is one keep tag a character and one insert tag more; other lengths raise an error. Null where one of the three is.
    """
    known = pc.and_(pc.and_(text.is_valid(), keep_tags.is_valid()), insert_tags.is_valid())
    text, keep_tags, insert_tags = (x.filter(known) for x in (text, keep_tags, insert_tags))
    n, n_keep, n_insert = (np.asarray(x, np.int64) for x in (pc.utf8_length(text), pc.list_value_length(keep_tags), pc.list_value_length(insert_tags)))
    if (n != n_keep).any() or (n + 1 != n_insert).any():
        raise ValueError("one keep tag a character and one insert tag more are needed")
    keep, insert, nothing = keep_tags.flatten(), insert_tags.flatten(), pa.scalar("")
    after = lambda tags: pc.utf8_slice_codeunits(tags, 2)
    kept = pc.if_else(pc.is_in(keep, pa.array(["K", "_"])), split_characters(text), pc.if_else(pc.starts_with(keep, "R:"), after(keep), nothing))
    added = pc.if_else(pc.starts_with(insert, "I:"), after(insert), nothing)
    ends = np.cumsum(n + 1)  # each text's last insert tag has no character behind it
    at = np.arange(len(insert)) - np.repeat(np.arange(len(n)), n + 1)
    at[ends - 1] = len(kept)
    both = pc.binary_join_element_wise(pc.fill_null(added, ""), pa.concat_arrays([pc.fill_null(kept, ""), pa.array([""])]).take(pa.array(at)), "")
    made = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), both), "")
    order = np.cumsum(np.asarray(known, bool)) - 1
    return made.take(pa.array(np.where(np.asarray(known, bool), order, 0), mask=~np.asarray(known, bool)))


def string_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after the other, and where each begins and the last ends. Nulls are empty."""
    values = pc.fill_null(values.cast(pa.string()), "")
    _, places, data = values.buffers()
    ends = np.frombuffer(places, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return own, ends - ends[0]


@batch("string")
def apply_edit_codes(text: pa.Array, keep: pa.Array, replacements: pa.Array, insert: pa.Array, insertions: pa.Array) -> pa.Array:
    """A text under edit tags that are written as codes: one string of K or _ (keep), D (drop) and R (replace) for its characters, and
    one of _ (nothing) and I (insert) for the places before each and at the end. replacements and insertions hold, in order, what the
    R and I stand for. The same as apply_edits(), without a string for each character. Null where one of the five is.
    """
    known = np.asarray(pc.and_kleene(pc.and_kleene(pc.and_kleene(text.is_valid(), keep.is_valid()), pc.and_kleene(replacements.is_valid(), insert.is_valid())), insertions.is_valid()), bool)
    some = pa.array(known)
    text, keep, replacements, insert, insertions = (x.filter(some) for x in (text, keep, replacements, insert, insertions))
    n = np.asarray(pc.utf8_length(text), np.int64)
    (kept, k_ends), (added, i_ends) = string_bytes(keep), string_bytes(insert)
    if (np.diff(k_ends) != n).any() or (np.diff(i_ends) != n + 1).any():
        raise ValueError("one keep code a character and one insert code more are needed")
    replaced, given = kept == ord("R"), added == ord("I")
    rows, i_rows = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), n + 1)
    if (np.bincount(rows[replaced], minlength=len(n)) != np.asarray(pc.list_value_length(replacements), np.int64)).any() or (np.bincount(i_rows[given], minlength=len(n)) != np.asarray(pc.list_value_length(insertions), np.int64)).any():
        raise ValueError("one replacement for each R and one insertion for each I are needed")
    chars, r, i = split_characters(text), replacements.flatten(), insertions.flatten()
    pool = pa.concat_arrays([chars, pc.fill_null(r.cast(pa.string()), ""), pc.fill_null(i.cast(pa.string()), ""), pa.array([""], pa.string())])
    nothing = len(pool) - 1
    from_text = np.where(replaced, len(chars) + np.cumsum(replaced) - 1, np.where(kept == ord("D"), nothing, np.arange(len(kept))))
    between = np.where(given, len(chars) + len(r) + np.cumsum(given) - 1, nothing)
    # before each character what is inserted there; the last insertion of a text has none behind it
    at = np.full(len(added) + len(kept), nothing)
    at[np.arange(len(added)) + np.arange(len(added)) - i_rows] = between
    at[2 * np.arange(len(kept)) + 1 + rows] = from_text
    made, ends = string_bytes(pool.take(pa.array(at)))
    bounds = ends[np.concatenate([[0], np.cumsum(2 * n + 1)])].astype(np.int32)  # what was taken lies side by side: texts are cut out of it
    out = pa.StringArray.from_buffers(len(n), pa.py_buffer(bounds), pa.py_buffer(made.tobytes()))
    order = np.cumsum(known) - 1
    return out.take(pa.array(np.where(known, order, 0), mask=~known))


def tag_window(tags: Column | str, n: Column | str, extra: int = 0) -> Column:
    """The tags of a text of n characters out of a sequence that starts with a special token."""
    return F.slice(_col(tags), F.lit(2), _col(n) + extra)


def char_tags(predictions: Column | str, special: Column | str, names: tuple[str, ...]) -> Column:
    """Tag names of predicted ids at the places that aren't special tokens (an array of booleans)."""
    labels = F.array(*[F.lit(n) for n in names])
    rows = F.filter(F.arrays_zip(_col(predictions).alias("p"), _col(special).alias("s")), lambda x: ~x["s"])
    return F.transform(rows, lambda x: F.element_at(labels, x["p"] + 1))


def _in(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def apply_norm_ops(surf: Column | str, ops: Column | str, strict: bool = False) -> Column:
    """A written form under its normalization operations, as kernels.norm.apply_ops does it, in Spark's own functions."""
    surf, ops = _col(surf), _col(ops)
    marks = F.lit(sorted(vocab.PROLONGED_MARKS))
    loose = F.lit(sorted(vocab.PROLONGED_MARKS | vocab.GEMINATES | set(vocab.SMALL_TO_LARGE)))

    def wrong(x: Column, why: str) -> Column:
        return F.raise_error(F.concat(F.lit(why + ": "), x)) if strict else x

    def step(acc: Column, x: Column) -> Column:
        c, op, out = x["c"], x["op"], acc["out"]
        last = F.right(out, F.lit(1))
        voiced, large = _in(c, vocab.VOICED_TO_VOICELESS), _in(c, vocab.SMALL_TO_LARGE)
        vowel = F.when(F.array_contains(marks, c) & (out != ""), F.when(op == "P", _in(last, vocab.PROLONGED_VOWEL)).otherwise(_in(last, vocab.PROLONGED_E)))
        first = (acc["i"] == 0) if strict else F.lit(True)
        made = (
            F.when(op == "K", c)
            .when(op == "D", F.lit("") if not strict else F.when(F.array_contains(loose, c), F.lit("")).otherwise(wrong(c, "not removable")))
            .when(op == "V", F.when(voiced.isNotNull() & first, voiced).otherwise(wrong(c, "not an initial voiced kana")))
            .when(op == "S", F.when(large.isNotNull(), large).otherwise(wrong(c, "not a small kana")))
            .when(op.isin("P", "E"), F.when(vowel.isNotNull(), vowel).otherwise(wrong(c, "doesn't prolong")))
            .otherwise(F.raise_error(F.concat(F.lit("unknown operation "), op)))
        )
        return F.struct((acc["i"] + 1).alias("i"), F.concat(out, made).alias("out"))

    rows = F.zip_with(characters(surf), ops, lambda c, op: F.struct(c.alias("c"), op.alias("op")))
    return F.aggregate(rows, F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step)["out"]


@arrow("array<string>")
def infer_norm_ops(surf: pd.Series, normal: pd.Series) -> pd.Series:
    """Operations from a written to a normal form; all "_" where there are none (an empty or longer normal form too).

    The distinct pairs of a batch are worked out together.
    """
    known = (surf.notna() & normal.notna()).to_numpy()
    pairs = list(zip(surf[known], normal[known], strict=True))
    out: list[list[str] | None] = [None] * len(surf)
    for k, (s, _), ops in zip(known.nonzero()[0].tolist(), pairs, norm_batch.infer_ops_of(pairs), strict=True):
        out[k] = [vocab.NORM_IGNORED] * len(s) if ops is None else ops
    return pd.Series(out)


def denormalize(surf: Column | str, mark: str = "ー") -> Column:
    """The deterministic spelling variant of a written form, in Spark's own functions."""
    surf = _col(surf)
    last = F.right(surf, F.lit(1))
    small = _in(last, vocab.LARGE_TO_SMALL)
    from tsumugi.functions.text import kanji_ga

    at = kanji_ga(surf)
    swapped = F.concat(F.substring(surf, F.lit(1), at), F.when(F.substring(surf, at + 1, F.lit(1)) == "ケ", F.lit("ヶ")).otherwise(F.lit("ケ")), F.substring(surf, at + 2, F.length(surf)))
    klass = lambda kana: "[" + "".join(sorted(kana)) + "]"
    pair = "|".join(f"(?<={klass(before)}){v}" for v, before in (("う", vocab.BEFORE_U), ("い", vocab.BEFORE_I), ("え", vocab.BEFORE_E)))
    # the last pair of the word: nothing but characters without a later pair may follow
    prolonged = F.regexp_replace(surf, f"(?:{pair})(?!.*(?:{pair}))", mark)
    return F.when(surf == "", surf).when(small.isNotNull(), F.concat(F.substring(surf, F.lit(1), F.length(surf) - 1), small)).when(at >= 0, swapped).otherwise(prolonged)


@arrow("string")
def denormalize_randomly(surf: pd.Series, seed: pd.Series) -> pd.Series:
    """A random spelling variant, the same for the same written form and seed (say, a hash of the row's key)."""
    import random

    return pd.Series([norm.denormalize_randomly(s, random.Random(f"{k}:{s}")) if s else s for s, k in zip(surf, seed, strict=True)])


def denormalize_sentence(words: Column | str, seed: Column | str, p: float = 0.5) -> Column:
    """Written forms of a sentence (array of structs surf, norm), of which some that are normal become variants, seeded by a key."""

    @arrow("array<string>")
    def vary(own: pd.Series, key: pd.Series) -> pd.Series:
        import random

        return pd.Series([norm.denormalize_sentence([(w["surf"], w["norm"] or "") for w in ws], random.Random(f"{k}"), p) if ws is not None else None for ws, k in zip(own, key, strict=True)])

    return vary(words, seed)


@arrow("array<struct<pre:string,post:string>>")
def char_diffs(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"pre": a, "post": b} for a, b in edits.char_diffs(x, y)] if x is not None and y is not None else None for x, y in zip(before, after, strict=True)])


@arrow("struct<tp:long,fp:long,fn:long>")
def diff_counts(before: pd.Series, predicted: pd.Series, gold: pd.Series) -> pd.DataFrame:
    rows = [edits.diff_counts(*(x or "" for x in r)) for r in zip(before, predicted, gold, strict=True)]
    return pd.DataFrame(rows, columns=["tp", "fp", "fn"], dtype="int64")


@arrow("struct<kdr_tags:array<string>,ins_tags:array<string>>")
def typo_gold_tags(before: pd.Series, after: pd.Series, diffs: pd.Series) -> pd.DataFrame:
    """Tags that turn before into after by the listed diffs (structs of pre_str, post_str); null if they differ elsewhere."""
    keep, insert = [], []
    for a, b, own in zip(before, after, diffs, strict=True):
        parts = edits.decompose(a, b, [(d["pre_str"], d["post_str"]) for d in own])
        k, i = edits.tags_of(parts, len(a) + 1) if parts is not None else (None, None)
        keep.append(k)
        insert.append(i)
    return pd.DataFrame({"kdr_tags": keep, "ins_tags": insert})
