"""Sinks: each stage's text form, and split corpora. Files are written by tasks; order is by the rows' own places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raw_block(doc_id: Column | str, text: Column | str) -> Column:
    """A document as raw text: its id line, if it has one, its text, and EOD."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.concat(F.coalesce(F.concat(F.lit("# D-ID:"), F.nullif(doc_id, F.lit("")), F.lit("\n")), F.lit("")), text, F.lit("\nEOD"))


def without_id_lines(text: Column | str) -> Column:
    """A raw text without its id lines, as shown to a user."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?m)^# D-ID:[^\n]*\n?", "")


def sentence_ids(sentences: DataFrame) -> DataFrame:
    """sid {doc}-{n} for sentences of windows (orig_id, win_idx, sent_idx): n counts from 1 on through a document's windows."""
    n = F.row_number().over(Window.partitionBy("orig_id").orderBy("win_idx", "sent_idx"))
    return sentences.withColumn("sid", F.concat_ws("-", "orig_id", n))


def spaced(comment: Column | str, surfs: Column | str) -> Column:
    """A sentence as its comment line, if any, and its words with spaces between."""
    comment, surfs = (F.col(c) if isinstance(c, str) else c for c in (comment, surfs))
    return F.concat(F.coalesce(F.concat(comment, F.lit("\n")), F.lit("")), F.array_join(surfs, " "))


def generated_text(ids: Column | str, vocab: Column | str, skipped: list[int]) -> Column:
    """Token ids as text: padding and end are left out, and spaces deleted. vocab is an array of tokens by id."""
    ids, vocab = (F.col(c) if isinstance(c, str) else c for c in (ids, vocab))
    kept = F.filter(ids, lambda i: ~i.isin(skipped))
    return F.translate(F.array_join(F.transform(kept, lambda i: F.element_at(vocab, i.cast("int") + 1)), ""), " ▁", "")


def document_texts(sentences: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("sent_idx",), text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """One text a document of its sentences' blocks, in order. carried: columns of the document to keep."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return sentences.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["_t"]), "").alias("text"), *[F.first(c).alias(c) for c in carried or ()])


def write_text(df: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """The texts as lines of files that are sorted by order within and across."""
    df.orderBy(*order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def append_epoch(batch: DataFrame, epoch: int, path: str, order: list[str], text: str = "text") -> None:
    """A micro-batch's texts, in order, as the epoch's own folder: an epoch that is run again takes the place of what it wrote before.

    So a stream that is killed between two batches, or within one, and restarted from its checkpoint gives each text once. The
    batch is persisted meanwhile: a sort looks at its rows twice, and a stateful operator would do all its work each time.
    """
    own = batch.select(*order, F.col(text).alias("value")).persist()
    try:
        own.orderBy(*order).select("value").write.mode("overwrite").text(f"{path}/epoch={epoch:012d}")
    finally:
        own.unpersist()


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """epoch, ord and line of what append_epoch() wrote: a line's number is its place within its epoch's files."""
    lines = spark.read.text(path).select(F.col("epoch").cast("long").alias("epoch"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    return lines.select("epoch", (F.row_number().over(Window.partitionBy("epoch").orderBy("file", "start", "at")) - 1).alias("ord"), "line")


def begin(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Clears the output of an earlier run, unless this one goes on from its checkpoint."""
    context = spark.sparkContext
    at = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(context._jsc.hadoopConfiguration())
    if not at(checkpoint).getFileSystem(context._jsc.hadoopConfiguration()).exists(at(checkpoint)):
        files.delete(at(path), True)


def write_splits(df: DataFrame, path: str, kind: str = "json", split: str = "split") -> None:
    """One folder a split."""
    df.write.mode("overwrite").partitionBy(split).format(kind).save(path)


def rendered(text: str) -> str:
    """What is printed for a result: nothing at all becomes the end mark of an empty document."""
    return text or "EOD\n"
