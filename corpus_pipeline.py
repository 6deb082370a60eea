"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns the columns of docs for the rows that it keeps, whatever other columns
there are; the last adds the mixture's order, and columns of its names give way. run() applies them one after the other.
Nulls, empty texts, repeated rows and empty tables: as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.llm import decontam, mixing, neardup, quality, substrings
from tsumugi.llm.common import stored, table

#: Columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; the machine is fitted on the labelled ones among them."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five-word shingles, similarity of 0.8)."""
    return neardup.keep_one_each(docs, neardup.near_groups(docs, neardup.Banded(shingle=5, similarity=0.8)))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; texts of which nothing stays go.

    n_chars, if docs has it, is the new text's where words went.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")  # whose names can't clash with new ones
    found = substrings.dedup_substrings(docs.select("doc_id", "text", others), layout=True).where("n_words = 0 or n_removed < n_words")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others.n_chars")).alias("n_chars")
    return found.select(*[changed.get(c, F.col(f"others.`{c}`")) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (five-word shingles, containment of 0.8)."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a mixture in which a source weighs the root of its number of documents."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix),
]

#: A fitted classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
