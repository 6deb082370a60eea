"""Segmentation: sentences and words from character tags, and tags from segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow, batch
from tsumugi.functions.edits import string_bytes
from tsumugi.operators.numbering import numbered, padded
from tsumugi.kernels import norm


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_sentences(text: Column | str, ends: str = ".!?。！？") -> Column:
    """Sentences by a regular rule: each ends after a run of end marks; what follows the last is one too. An empty text has none.

    The text is cut between an end mark and what is none, which takes about a fifth of the time of extracting the matches.
    """
    own = "".join("\\" + c if c in r"\]^-" else c for c in ends)
    return F.array_remove(F.split(_col(text), f"(?<=[{own}])(?=[^{own}])"), "")


@batch("array<string>")
def sentences_by_tags(text: pa.Array, tags: pa.Array) -> pa.Array:
    """Sentences of a text by one tag a character: B begins one. Characters without a tag, and tags without one, are left out.

    Tags are an array of strings, or one string of letters (see segment_codes()), which spares a string for each character.
    """
    known = np.asarray(pc.and_(text.is_valid(), tags.is_valid()), bool)
    some = pa.array(known)
    own, of = text.filter(some), tags.filter(some)
    n = np.asarray(pc.utf8_length(own), np.int64)
    if pa.types.is_string(tags.type):
        codes, ends = string_bytes(of)
        n_tags, begins = np.diff(ends), np.flatnonzero(codes == ord("B"))
    else:
        n_tags = np.asarray(pc.list_value_length(of), np.int64)
        begins = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(of.flatten(), "B"), False), bool))
    first = np.cumsum(n_tags) - n_tags
    row = np.searchsorted(first, begins, side="right") - 1
    at = begins - first[row]
    upto = np.minimum(n, n_tags)
    inner = (at > 0) & (at < upto[row])
    out: list[list[str] | None] = [None] * len(text)
    cuts = np.split(at[inner], np.searchsorted(row[inner], np.arange(1, len(n))))[: len(n)]  # one at least, even of none
    for place, t, mine, m in zip(np.flatnonzero(known).tolist(), own.to_pylist(), cuts, upto.tolist(), strict=True):
        out[place] = [t[a:b] for a, b in zip([0, *mine.tolist()], [*mine.tolist(), m], strict=True)] if m else []
    return pa.array(out, pa.list_(pa.string()))


WORDS = "array<struct<sent_idx:int,surf:string,norm:string>>"


@arrow(WORDS)
def words_by_tags(sentences: pd.Series, tags: pd.Series, ops: pd.Series) -> pd.Series:
    """Words of a document's sentences by tags that run through all of them. A space is always a word of its own.

    norm is the word under its normalization operations, loosely; a word that they empty keeps its written form.
    """

    def one(own, word_tags, norm_ops) -> list[dict]:
        out, at = [], 0
        for k, sentence in enumerate(own):
            surf, begin = "", at

            def close() -> None:
                if surf:
                    out.append({"sent_idx": k, "surf": surf, "norm": norm.apply_ops(surf, list(norm_ops[begin : begin + len(surf)]), strict=False) or surf})

            for c in sentence:
                if c == " " or word_tags[at] == "B":
                    close()
                    surf, begin = "", at
                if c == " ":
                    out.append({"sent_idx": k, "surf": " ", "norm": " "})
                    begin = at + 1
                else:
                    surf += c
                at += 1
            close()
        return out

    return pd.Series([one(s, t, o) if s is not None and t is not None and o is not None else None for s, t, o in zip(sentences, tags, ops, strict=True)])


def split_words(text: Column | str) -> Column:
    """Words by a regular rule: runs of letters and digits, single other characters, and each space alone."""
    return F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{N}]+|."), F.lit(0))


def unknown_attributes(words: DataFrame) -> DataFrame:
    """Words with the attributes of an unknown part of speech."""
    return words.withColumns({"pos": F.lit("未定義語"), "pos_id": F.lit(15), "subpos": F.lit("その他"), "subpos_id": F.lit(1), "conjtype": F.lit("*"), "conjtype_id": F.lit(0), "conjform": F.lit("*"), "conjform_id": F.lit(0)})


def unknown_morphemes(words: DataFrame) -> DataFrame:
    """Words (surf, norm) as morphemes of which only form and lemma are known."""
    lemma = F.coalesce(F.nullif("norm", F.lit("")), F.col("surf"))
    return unknown_attributes(words.select(*[c for c in words.columns if c not in ("surf", "norm")], "surf", F.lit("_").alias("reading"), lemma.alias("lemma")))


def segment_codes(segments: Column | str) -> Column:
    """One string of B and I for the characters of the segments (an empty segment is a B)."""
    return F.array_join(F.transform(_col(segments), lambda s: F.rpad(F.lit("B"), F.greatest(F.length(s), F.lit(1)), F.lit("I"))), "")


def segment_tags(segments: Column | str) -> Column:
    """B and I for each character of the segments, as an array."""
    return F.split(segment_codes(segments), "")


def spans(segments: DataFrame, key: list[str], order: str, surf: str = "surf") -> DataFrame:
    """start and end (in characters of the document) of each segment."""
    upto = F.sum(F.length(surf)).over(Window.partitionBy(*key).orderBy(order))
    return segments.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length(surf))


def assign_doc_ids(docs: DataFrame, prefix: str, order: tuple[str, ...] = ("path", "ord")) -> DataFrame:
    """doc_id {prefix}-{number} where it is null or empty: the document's number from 0 among all of docs, over all files.

    Numbers are padded to the digits of the number of documents. docs must have the columns of the order that tells the
    documents apart; those among it that docs lacks are left out.
    """
    own = [c for c in order if c in docs.columns]
    made = F.concat(F.lit(f"{prefix}-"), padded(F.col("_number"), F.length(F.col("_total").cast("string"))))
    return numbered(docs, own, "_number", "_total").withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), made)).drop("_number", "_total")


def assign_sentence_ids(sentences: DataFrame) -> DataFrame:
    """sid {doc_id}-{sent_idx} where it is null or empty, padded to the digits of the largest document's number of sentences."""
    counts = sentences.groupBy("doc_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("_n"))
    made = F.concat_ws("-", "doc_id", padded(F.col("sent_idx"), F.length(F.col("_n").cast("string"))))
    return sentences.crossJoin(F.broadcast(most)).withColumn("sid", F.coalesce(F.nullif("sid", F.lit("")), made)).drop("_n")


def eligible(text: Column | str, n_tokens: Column | str, most: int) -> Column:
    """Whether the typo stage can take a text: a token a character, and room for three special tokens."""
    return (_col(n_tokens) == F.length(_col(text))) & (F.length(_col(text)) <= most - 3)


def corrected_or_kept(docs: DataFrame, corrected: str = "corrected", text: str = "text", fits: str = "eligible") -> DataFrame:
    """Documents with the corrected text where the stage could take them, else as they are, in their own places."""
    return docs.withColumn(text, F.when(F.col(fits), F.col(corrected)).otherwise(F.col(text))).drop(corrected, fits)


def length_guard(rows: DataFrame, size: Column | str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows that a stage can take, and the others."""
    fits = F.coalesce(_col(size) <= most, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def without_bracket_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences whose comment doesn't say that they were taken out of brackets."""
    return sentences.where(~F.coalesce(F.contains("comment", F.lit("括弧位置")), F.lit(False)))


def gold_char_tags(morphemes: DataFrame, targets: Column | str | None = None) -> DataFrame:
    """doc_id, global places and gold tags of each character of the morphemes (doc_id, sent_idx, morph_idx, surf, ops).

    Characters of sentences that aren't targets have null tags, but count.
    """
    order = Window.partitionBy("doc_id").orderBy("sent_idx", "morph_idx")
    chars = morphemes.withColumn("target", F.lit(True) if targets is None else _col(targets)).withColumn("base", F.sum(F.length("surf")).over(order) - F.length("surf"))
    each = chars.select("doc_id", "sent_idx", "morph_idx", "target", "base", "ops", F.posexplode(F.split("surf", "")).alias("k", "char"))
    tag = lambda c: F.when(F.col("target"), c)
    return each.select(
        "doc_id", (F.col("base") + F.col("k")).cast("int").alias("offset"), "char",
        tag(F.when((F.col("morph_idx") == 0) & (F.col("k") == 0), "B").otherwise("I")).alias("sent_tag"), tag(F.when(F.col("k") == 0, "B").otherwise("I")).alias("word_tag"), tag(F.element_at("ops", F.col("k") + 1)).alias("norm_op"),
    )
