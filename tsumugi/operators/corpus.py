"""Corpus preparation: splits, samples, frequency tables and training examples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.arrow import arrow
from tsumugi.functions.edits import typo_gold_tags
from tsumugi.functions.text import normalize_text
from tsumugi.operators.numbering import numbered


def counts(rows: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Occurrences of each value. Order them by (n desc, value) where they are shown."""
    c = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(c.alias(name)).agg(F.count("*").alias("n"))


def relation_counts(base_phrases: DataFrame, rels: str = "rels") -> DataFrame:
    """How often base phrases have each type of relation."""
    return base_phrases.select(F.explode(rels).alias("r")).groupBy(F.col("r.type").alias("type")).agg(F.count("*").alias("n"))


def most_common_first(table: DataFrame, value: str = "value") -> DataFrame:
    return table.orderBy(F.desc("n"), value)


def insertion_counts(examples: DataFrame, tags: str = "ins_tags", least: int = 2) -> DataFrame:
    """Inserted strings of over one character that occur at least so often, with their numbers."""
    each = examples.select(F.explode(tags).alias("t")).where(F.startswith("t", F.lit("I:"))).select(F.substring(F.col("t"), F.lit(3), F.length("t")).alias("value")).where(F.length("value") > 1)
    return counts(each, "value").where(F.col("n") >= least)


def seeded_split(rows: DataFrame, key: str, seed: int = 42, shares: tuple[float, float] = (0.9, 0.05)) -> DataFrame:
    """split (train, valid, test) of rows in a seeded order of their keys (md5 of "seed:key"): floors of the shares for train and valid.

    Exact sizes need the place of each key in that order, which numbered() gives. Rows of equal keys are beside each
    other, in any order; otherwise the split doesn't depend on how rows are dealt out. Null keys are keys too.
    """
    ranked = numbered(rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))), ["_h", key], "_k", "_total")
    n_train, n_valid = F.floor(F.col("_total") * shares[0]), F.floor(F.col("_total") * shares[1])
    return ranked.withColumn("split", F.when(F.col("_k") < n_train, "train").when(F.col("_k") < n_train + n_valid, "valid").otherwise("test")).drop("_h", "_k", "_total")


def hold_out(rows: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """split: the first n rows of each category are valid, others (and those without a category) train.

    Only the first n keys of a category are ranked (tasks leave the others out before the shuffle); rows are then compared with
    the last of them. Rows of equal order are told apart by a hash of the whole row; rows equal throughout stay together.
    """
    key = F.struct(F.col(order).alias("k"), F.xxhash64(*rows.columns).alias("h"))
    keyed = rows.withColumn("_key", key)
    ranked = keyed.where(F.col(category).isNotNull()).select(F.col(category).alias("_of"), "_key").withColumn("_k", F.row_number().over(Window.partitionBy("_of").orderBy("_key"))).where(F.col("_k") <= n)
    last = ranked.groupBy("_of").agg(F.max("_key").alias("_last"))
    return keyed.join(last, F.col(category) == F.col("_of"), "left").withColumn("split", F.when(F.col("_key") <= F.col("_last"), "valid").otherwise("train")).drop("_key", "_of", "_last")


def capped(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first rows of each key, at most so many."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def capped_sample(sentences: DataFrame, per_key: int, total: int) -> DataFrame:
    """ord and keys of sentences (ord, keys: array) taken in order while a key of theirs has been taken less than per_key times.

    A sentence is taken, until there are total of them, if a key of its own still has room; the keys that have are returned. So
    a key has room in just the first per_key sentences that have it, taken or not: each of those takes it. Hence the keys
    are ranked apart (a window a key, of which only the first per_key rows stay), and the first total sentences are kept.
    Null and empty keys, and nulls among them, give nothing.
    """
    each = sentences.select("ord", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    room = each.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where(F.col("_k") <= per_key)
    return room.groupBy(F.col("ord").cast("long").alias("ord")).agg(F.array_sort(F.collect_set("key")).alias("keys")).orderBy("ord").limit(total)


def length_buckets(examples: DataFrame, size: Column | str, n: int) -> DataFrame:
    """Examples dealt out by size, sorted within: neighbours are of like length, for batches without much filling."""
    c = F.col(size) if isinstance(size, str) else size
    return examples.withColumn("_size", c).repartitionByRange(n, "_size").sortWithinPartitions("_size").drop("_size")


def renumbered(examples: DataFrame, *order: str) -> DataFrame:
    """example_id from 0 in the given order; nulls come first. See numbered()."""
    return numbered(examples, list(order), "example_id")


def typo_examples(raw: DataFrame, train: bool) -> DataFrame:
    """Training examples of raw ones (pre_text, post_text, diffs: pre_str, post_str, category): texts, tags and category.

    All is normalized, diffs that aren't typos are left out, examples that differ elsewhere are dropped. In training data,
    examples with one diff have its category (for the hold-out), others have none.
    """
    diffs = F.filter("diffs", lambda d: d["category"] != "not-typo")
    own = raw.select(normalize_text("pre_text").alias("pre_text"), normalize_text("post_text").alias("post_text"), diffs.alias("diffs"))
    flat = own.withColumn("diffs", normalize_diffs(F.col("diffs")))
    tagged = flat.withColumn("t", typo_gold_tags("pre_text", "post_text", "diffs")).where("t.kdr_tags is not null")
    category = F.when(F.lit(train) & (F.size("diffs") == 1), F.element_at("diffs", 1)["category"])
    return tagged.select("pre_text", "post_text", "t.kdr_tags", "t.ins_tags", category.alias("category"))


@arrow("array<struct<pre_str:string,post_str:string,category:string>>")
def normalize_diffs(diffs: pd.Series) -> pd.Series:
    import unicodedata

    from tsumugi.vocab import DELETED, REPLACED

    table = str.maketrans("".join(REPLACED), "".join(REPLACED.values()), DELETED)
    clean = lambda t: unicodedata.normalize("NFKC", t).translate(table)
    return diffs.map(lambda own: [{"pre_str": clean(d["pre_str"]), "post_str": clean(d["post_str"]), "category": d["category"]} for d in own])


def partial_matches(sentences: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotated words of sentences (ord, text, morphemes: array of structs with surf) by their record (ord, text, surf, ...).

    Gives the matches (ord, morph_idx and the annotation), and how many sentences were left out for which reason.
    """
    r = records.select("ord", F.col("text").alias("_text"), F.col("surf").alias("_surf"), "lemma", "conjtype", "conjform")
    both = sentences.join(r, "ord")
    hits = F.filter(F.transform("morphemes", lambda m, i: F.struct(i.alias("i"), m["surf"].alias("s"))), lambda x: x["s"] == F.col("_surf"))
    judged = both.withColumn("hits", hits).withColumn("reason", F.when(F.col("text") != F.col("_text"), "text_mismatch").when(F.size("hits") == 0, "no_info"))
    found = judged.where("reason is null").select("ord", F.explode("hits").alias("h"), "lemma", "conjtype", "conjform").select("ord", F.col("h.i").alias("morph_idx"), F.col("h.s").alias("surf"), "lemma", "conjtype", "conjform")
    return found, judged.where("reason is not null").groupBy("reason").count()


def with_splits(docs: DataFrame, splits: DataFrame) -> DataFrame:
    """Documents with their split; those that have none are left out."""
    return docs.join(splits.select("doc_id", "split"), "doc_id")


def compared(system: DataFrame, baseline: DataFrame, gold: DataFrame) -> DataFrame:
    """Sentences (sid, morphemes) that all three have."""
    named = [df.select("sid", F.col("morphemes").alias(n)) for df, n in ((system, "system"), (baseline, "baseline"), (gold, "gold"))]
    return named[0].join(named[1], "sid").join(named[2], "sid")


def all_corpora(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of the corpora's rows, with their names."""
    out: DataFrame | None = None
    for name, df in parts.items():
        own = df.withColumn("corpus", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no corpora")
    return out
