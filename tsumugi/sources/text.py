"""Text sources: raw documents, line-by-line sentences, annotated documents, and lists.

A file is read as one text where its documents need it (whole), so a corpus should be many files; each file is one task's
work at most and files are read in parallel.
"""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow, batch
from tsumugi.functions.text import doc_id_of, normalize_text, without_doc_id
from tsumugi.kernels import formats
from tsumugi.schema import SENTENCE


def whole_files(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path and text of each file."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def existing(paths: list[str], suffix: str) -> list[str]:
    """Files of the suffix among paths and below those that are folders, sorted; paths that don't exist are left out. For local paths."""
    out: set[str] = set()
    for p in map(Path, paths):
        out |= {str(p)} if p.is_file() and p.name.endswith(suffix) else {str(f) for f in p.rglob(f"*{suffix}")} if p.is_dir() else set()
    return sorted(out)


def normalized_lines(files: DataFrame) -> DataFrame:
    """Texts whose lines are normalized one by one, so that the line ends stay."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", normalize_text("line"))
    rows = F.array_sort(F.collect_list(F.struct("n", "line")))
    return lines.groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def raw_chunks(text: Column | str) -> Column:
    """Documents of a raw text: each line EOD ends one, even an empty one; what follows the last counts if it isn't blank."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, r"(?m)^[^\S\n]*EOD[^\S\n]*(?:\n|\z)")
    cut = F.transform(parts, lambda p: F.regexp_replace(p, r"\s+\z", ""))
    last = F.element_at(cut, -1)
    return F.when(last == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def raw_documents(files: DataFrame) -> DataFrame:
    """path, ord, doc_id (null without a line "# D-ID:x") and text of each document of the files."""
    each = files.select("path", F.posexplode(raw_chunks("text")).alias("ord", "chunk"))
    return each.select("path", "ord", doc_id_of("chunk").alias("doc_id"), without_doc_id("chunk").alias("text"))


def read_raw(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return raw_documents(whole_files(spark, paths, **options))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """Documents of a text given as such."""
    return raw_documents(spark.createDataFrame([("", text)], "path string, text string"))


def line_sentences(lines: DataFrame) -> DataFrame:
    """Sentences of lines (path, line_no, line): a text line with the comment lines before it; blank lines are skipped.

    Gives path, sent_idx, comment (its lines joined), line; comments after the last text line form one without text. The
    islands are cut within a file, so each file is one window.
    """
    filled = lines.where(F.trim("line") != "").withColumn("is_text", (~F.startswith("line", F.lit("#"))).cast("int"))
    own = Window.partitionBy("path").orderBy("line_no")
    island = filled.withColumn("sent_idx", F.sum("is_text").over(own) - F.col("is_text"))
    grouped = island.groupBy("path", "sent_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_text") == 0, F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("comment"),
        F.max(F.when(F.col("is_text") == 1, F.col("line"))).alias("line"),
    )
    return grouped


def line_documents(sentences: DataFrame) -> DataFrame:
    """Runs of sentences (path, sent_idx, doc_id, text) with one doc_id, in order: path, doc_ord, doc_id, text.

    A doc_id that comes back later begins a new document.
    """
    own = Window.partitionBy("path").orderBy("sent_idx")
    begins = (~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(own)) | (F.row_number().over(own) == 1)).cast("int")
    runs = sentences.withColumn("begins", begins).withColumn("doc_ord", F.sum("begins").over(own) - 1)
    return runs.groupBy("path", "doc_ord").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "text"))), lambda x: x["text"]), "").alias("text"))


@arrow(f"array<{SENTENCE}>")
def parse_annotated(text: pd.Series) -> pd.Series:
    """The sentences of a text of morpheme lines, with or without phrases."""
    return text.map(formats.parse_document, na_action="ignore")


def sentence_texts(text: Column | str) -> Column:
    """The lines of each sentence of a text of morpheme lines: up to each EOS, and what follows the last one, if anything."""
    cut = F.split(text, r"(?md)^\r*EOS\r*$\n?", -1)
    last = F.element_at(cut, -1)
    return F.when(F.replace(last, F.lit("\n"), F.lit("")) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


@arrow(SENTENCE)
def parse_sentences(text: pd.Series) -> pd.Series:
    """A sentence of its lines, without EOS. With sentence_texts() what parse_annotated() gives, without a text's sentences in one row."""
    return text.map(lambda t: formats.parse_sentence([x for x in t.split("\n") if x]), na_action="ignore")


@batch("string")
def emit_annotated(sid: pa.Array, comment: pa.Array, morphemes: pa.Array, base_phrases: pa.Array, phrases: pa.Array) -> pa.Array:
    """The lines of a sentence."""
    rows = zip(*[x.to_pylist() for x in (sid, comment, morphemes, base_phrases, phrases)], strict=True)
    return pa.array([formats.emit_sentence({"sid": s, "comment": c, "morphemes": m, "base_phrases": b, "phrases": p}) for s, c, m, b, p in rows], pa.string())


def read_annotated(spark: SparkSession, paths: str | list[str], glob: str | None = "*.knp", recursive: bool = False, with_path: bool = False) -> DataFrame:
    """doc_id (of the sentence ids, else the file's name), sent_idx and the sentence columns of each sentence of the files."""
    return annotated(whole_files(spark, paths, glob, recursive), with_path)


def annotated(files: DataFrame, with_path: bool = False) -> DataFrame:
    """doc_id, sent_idx and the sentence columns (and path, if asked for) of annotated texts (path, text)."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    each = files.select("path", name.alias("file"), F.posexplode(sentence_texts("text")).alias("sent_idx", "t")).withColumn("s", parse_sentences("t"))
    doc_id = F.coalesce(F.nullif(F.regexp_extract(F.col("s.sid"), r"^(.*)-[^-]+$", 1), F.lit("")), F.col("file"))
    return each.select(doc_id.alias("doc_id"), "sent_idx", "s.*", *["path"] * with_path)


def read_typo_examples(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """example_id (from 0, by file and line), doc_id (empty) and the texts and tags of JSON lines, in all folders below."""
    schema = "pre_text string, post_text string, kdr_tags array<string>, ins_tags array<string>"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    rows = rows.select("*", F.input_file_name().alias("_path"), F.monotonically_increasing_id().alias("_line"))
    # ids run over all files: files are counted first, lines numbered within their file
    counts = rows.groupBy("_path").count()
    before = counts.select("_path", (F.sum("count").over(Window.orderBy("_path")) - F.col("count")).alias("_before"))  # a row a file
    line = F.row_number().over(Window.partitionBy("_path").orderBy("_line")) - 1
    return rows.withColumn("_n", line).join(before, "_path").select((F.col("_before") + F.col("_n")).cast("int").alias("example_id"), F.lit("").alias("doc_id"), *schema_names(schema))


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def read_split_ids(spark: SparkSession, path: str, only_all: bool = False) -> DataFrame:
    """doc_id and split of the lines of *.id files; dev counts as valid. only_all: just the file all.id, as "all"."""
    rows = whole_files(spark, path, "*.id").select(F.regexp_extract("path", r"([^/]+)\.id$", 1).alias("name"), F.explode(F.split("text", "\n")).alias("doc_id"))
    rows = rows.select(F.trim("doc_id").alias("doc_id"), F.when(F.col("name") == "dev", "valid").otherwise(F.col("name")).alias("split")).where("doc_id != ''")
    return rows.where("split = 'all'") if only_all else rows.where("split != 'all'")


def read_partial_annotations(files: DataFrame) -> DataFrame:
    """Records of a partial annotation (blank lines between): path, ord, text, surf, lemma, conjtype, conjform.

    A line that starts with a tab holds an annotated word and its annotations; other lines are plain text.
    """
    each = files.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\n+\z", ""), r"\n\n")).alias("ord", "record"))
    lines = F.split("record", "\n")
    annotated = F.filter(lines, lambda x: F.startswith(x, F.lit("\t")))
    word = lambda x: F.when(F.startswith(x, F.lit("\t")), F.split(x, "\t")[1]).otherwise(x)
    last = F.try_element_at(annotated, F.lit(-1))

    def value(key: str) -> Column:
        found = F.filter(F.flatten(F.transform(annotated, lambda x: F.split(x, "\t"))), lambda a: F.startswith(a, F.lit(key + ":")))
        return F.substring(F.try_element_at(found, F.lit(-1)), F.lit(len(key) + 2), F.length(F.try_element_at(found, F.lit(-1))))

    return each.select("path", "ord", F.array_join(F.transform(lines, word), "").alias("text"), F.try_element_at(F.split(last, "\t"), F.lit(2)).alias("surf"), value("baseform").alias("lemma"), value("conjtype").alias("conjtype"), value("conjform").alias("conjform"))
