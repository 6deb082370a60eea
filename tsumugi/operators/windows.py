"""Windows over documents' sentences, and runs over ordered rows."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow
from tsumugi.functions.text import make_window_id
from tsumugi.kernels.spans import split_spans


def window_spans(max_length: int, stride: int):
    """A pandas function: lengths of a document's items -> spans of its windows."""

    @arrow("array<struct<start:int,end:int>>")
    def spans(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: [{"start": a, "end": b} for a, b in split_spans([int(n) for n in x], max_length, stride)], na_action="ignore")

    return spans


def placed_spans(max_length: int, stride: int):
    """A pandas function: lengths of a document's sentences and their numbers of words -> its windows, one if it fits, none without a sentence.

    before is the end of the window before, size the window's length; first_word is a place in the document, doc_words the document's number of words.
    """

    @arrow("array<struct<start:int,end:int,before:int,size:int,fits:boolean,first_word:int,doc_words:int,n_words:int,n_targets:int>>")
    def spans(lengths: pd.Series, n_words: pd.Series) -> pd.Series:
        def one(lengths, n_words) -> list[dict]:
            upto, words = [0, *accumulate(int(n) for n in lengths)], [0, *accumulate(int(n) for n in n_words)]
            fits = upto[-1] <= max_length
            found = [(0, len(lengths))][: len(lengths)] if fits else split_spans([int(n) for n in lengths], max_length, stride)
            ends = [0, *[b for _, b in found]]
            return [{"start": a, "end": b, "before": last, "size": upto[b] - upto[a], "fits": fits, "first_word": words[a], "doc_words": words[-1], "n_words": words[b] - words[a], "n_targets": words[b] - words[last]} for (a, b), last in zip(found, ends, strict=False)]

        return pd.Series([None if x is None or n is None else one(x, n) for x, n in zip(lengths, n_words, strict=True)], dtype=object)

    return spans


def document_spans(sentences: DataFrame, max_length: int, stride: int = -1, size: str = "n_tokens") -> DataFrame:
    """Each document's windows: doc_id, fits (it is one window), spans of places among its sentences (doc_id, sent_idx, size)."""
    lengths = sentences.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", size))), lambda x: x[size].cast("int")).alias("lengths"))
    fits = F.aggregate("lengths", F.lit(0), lambda a, x: a + x) <= max_length
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("lengths").alias("end")))
    return lengths.select("doc_id", fits.alias("fits"), F.when(fits, whole).otherwise(window_spans(max_length, stride)("lengths")).alias("spans"))


def split_documents(sentences: DataFrame, max_length: int, stride: int = -1, size: str = "n_tokens") -> DataFrame:
    """Sentences (doc_id, sent_idx, size and others) of each window: window_id, win_idx, sent_idx, target.

    A document that fits is one window and keeps its id. In others, the sentences by which a window ends after the one before are
    its targets: each sentence is a target once. stride is how many that should be (-1: windows don't overlap). A sentence is repeated in each window that holds it. The lengths of a document's
    sentences are brought together, their texts aren't.
    """
    each = document_spans(sentences, max_length, stride, size).select("doc_id", "fits", "spans", F.posexplode("spans").alias("win_idx", "span"))
    own_stride = F.col("span.end") - F.coalesce(F.get("spans", F.col("win_idx") - 1)["end"], F.lit(0))
    windows = each.select(
        "doc_id", "win_idx", F.when(F.col("fits"), F.col("doc_id")).otherwise(F.concat(F.col("doc_id"), F.lit("-s"), own_stride.cast("string"), F.lit("i"), F.col("win_idx").cast("string"))).alias("window_id"),
        F.col("span.end").alias("_end"), own_stride.alias("_stride"), F.explode(F.sequence(F.col("span.start"), F.col("span.end") - 1)).alias("sent_idx"),
    )
    own = windows.select("doc_id", "win_idx", "window_id", "sent_idx", (F.col("sent_idx") >= F.col("_end") - F.col("_stride")).alias("target"))
    return own.join(sentences, ["doc_id", "sent_idx"])


def target_sentences(windows: DataFrame) -> DataFrame:
    return windows.where("target")


def first_of_each(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """The first row to arrive of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(arrival))).where("_k = 1").drop("_k")


def bio_spans(tags: DataFrame, keys: list[str], order: str, tag: str = "tag") -> DataFrame:
    """category, start and end (places, end excluded) of the entities: an I- only goes on with its own category."""
    w = Window.partitionBy(*keys).orderBy(order)
    kind, category = F.substring(tag, 1, 1), F.substring(F.col(tag), F.lit(3), F.length(tag))
    # an entity is a B- and the I- of its category right after it: any other tag breaks the run
    broken = (kind == "B") | (kind == "O") | (category != F.coalesce(F.lag(category).over(w), F.lit("")))
    rows = tags.select(*keys, order, kind.alias("_kind"), category.alias("_category"), F.sum(broken.cast("int")).over(w).alias("_run"))
    runs = rows.groupBy(*keys, "_run").agg(F.min_by("_kind", order).alias("_first"), F.min("_category").alias("category"), F.min(order).alias("start"), (F.max(order) + 1).alias("end"))
    return runs.where("_first = 'B'").select(*keys, "category", "start", "end")


def head_runs(tags: DataFrame, keys: list[str], order: str, category: str = "category", part: str = "part") -> DataFrame:
    """Entities from single/head/middle/tail marks: head, middles and a tail of one category, or single."""
    w = Window.partitionBy(*keys).orderBy(order)
    begins = F.col(part).isin("single", "head")
    rows = tags.withColumn("_run", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(w))
    runs = Window.partitionBy(*keys, "_run").orderBy(order)
    lead = rows.withColumn("_cat", F.first(category).over(runs)).where((F.col(category) == F.col("_cat")) & (F.col("_run") > 0))
    # marks after the entity's end (a single or the first tail) don't belong to it
    ended = F.sum(F.col(part).isin("single", "tail").cast("int")).over(runs) - F.col(part).isin("single", "tail").cast("int")
    own = lead.withColumn("_ended", ended).where("_ended = 0")
    grouped = own.groupBy(*keys, "_run").agg(F.first("_cat").alias("category"), F.array_sort(F.collect_list(order)).alias("places"), F.max(F.col(part).isin("single", "tail")).alias("_whole"))
    return grouped.where("_whole").select(*keys, "category", "places")


def clause_islands(units: DataFrame, keys: list[str], order: str, boundary: Column | str) -> DataFrame:
    """clause number of each unit: a clause ends at a boundary, and at the last unit."""
    boundary = F.col(boundary) if isinstance(boundary, str) else boundary
    w = Window.partitionBy(*keys).orderBy(order)
    return units.withColumn("clause", F.coalesce(F.sum(boundary.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def clause_heads(units: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """The unit of each clause with the highest score, the first of equal ones."""
    return units.groupBy(*keys, "clause").agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("head"))


__all__ = ["bio_spans", "clause_heads", "clause_islands", "document_spans", "first_of_each", "head_runs", "make_window_id", "placed_spans", "split_documents", "target_sentences", "window_spans"]
