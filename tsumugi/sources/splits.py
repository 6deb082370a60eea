"""Raw documents of files of any size: each task reads a byte range of a file, and documents that cross ranges are put together.

Spark's text reader deals files out by byte ranges and gives each line to the range that it begins in. A range's lines are cut
at the end marks on their own: what lies between two of them is whole. What comes before the first and after the last is a
piece of a document that may go on in the ranges beside it; only such pieces are shuffled, two a range at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.functions.text import doc_id_of, without_doc_id

PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("closed", pa.bool_()), ("text", pa.string())])
MARK = "EOD"


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and pieces of the lines (path, start, line) of ranges: k counts the end marks before it, closed if one follows."""
    at, k, lines = None, 0, []

    def piece(closed: bool) -> dict:
        return {"path": at[0], "start": at[1], "k": k, "closed": closed, "text": "\n".join(lines)}

    for batch in batches:
        out = []
        for path, start, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (path, start) != at:
                if lines:
                    out.append(piece(False))
                at, k, lines = (path, start), 0, []
            if line.strip() == MARK:
                out.append(piece(True))
                k, lines = k + 1, []
            else:
                lines.append(line)
        yield pa.RecordBatch.from_pylist(out, schema=PIECES)
    if lines:
        yield pa.RecordBatch.from_pylist([piece(False)], schema=PIECES)


def range_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, start (the byte at which the range begins that holds it) and line; the lines of a range are in their order."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def read_raw_splits(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, ord, doc_id and text of the raw documents of files, which may be larger than a task can read.

    The rows of read_raw(), for lines that end in a line feed: a line EOD (spaces around it don't count) ends a document, even an empty one;
    what follows the last counts if it isn't blank. The end marks of ranges are counted first, by a pass without Python; a
    file's counts, one row a range, are added up in one window. A document has to fit into memory, a file hasn't.
    """
    lines = range_lines(spark, paths, glob, recursive)
    # every range has a row, with or without marks
    counts = lines.groupBy("path", "start").agg(F.count_if(F.trim(F.regexp_replace("line", r"\s", " ")) == MARK).alias("n"))
    before = counts.select("path", "start", (F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")).alias("before"))
    found = lines.mapInArrow(pieces_of, "path string, start long, k long, closed boolean, text string")
    placed = found.join(before, ["path", "start"]).withColumn("ord", (F.col("before") + F.col("k")).cast("int"))
    inner = (F.col("closed")) & ((F.col("k") > 0) | (F.col("start") == 0))
    whole = placed.where(inner).select("path", "ord", "text", "closed")
    crossing = placed.where(~inner).groupBy("path", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("closed").alias("closed"))
    documents = whole.unionByName(crossing).withColumn("text", F.regexp_replace("text", r"\s+\z", "")).where("closed or text != ''")
    return documents.select("path", "ord", doc_id_of("text").alias("doc_id"), without_doc_id("text").alias("text"))
