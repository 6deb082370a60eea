"""Loaders: examples in a seeded order, and batches of examples of like length within a budget of tokens.

An epoch's order comes from a hash of seed, epoch and key: rows are dealt into blocks by it and ordered within their block. That is one
shuffle and no sort of the whole, and a block is all that a task holds. Validation and prediction keep the given order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(seed: int, epoch: int, key: Column | str) -> Column:
    """What an epoch is ordered by: a hash of seed, epoch and key as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), (F.col(key) if isinstance(key, str) else key).cast("string")))


def block_of(draw: Column | str, blocks: int) -> Column:
    return (F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % blocks).cast("int")


def epoch_of(examples: DataFrame, key: str, seed: int, epoch: int = 0, blocks: int = 64) -> DataFrame:
    """examples with block and place (from 0 within the block): each once, in an order that seed and epoch give.

    Read block by block, that is a shuffled epoch. key must tell examples apart; those of equal keys are in any order.
    """
    own = examples.withColumn("_draw", drawn(seed, epoch, key)).withColumn("block", block_of("_draw", blocks))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("_draw", key)) - 1).drop("_draw")


def length_range(length: Column | str, ratio: float = 1.25) -> Column:
    """The range of a length: n holds lengths over ratio ** (n - 1) and up to ratio ** n; lengths up to 1 are in range 0."""
    c = F.col(length) if isinstance(length, str) else length
    return F.when(c <= 1, 0).otherwise(F.ceil(F.log(c.cast("double")) / math.log(ratio) - 1e-9)).cast("int")


def batches(examples: DataFrame, key: str, length: str, budget: int, seed: int, epoch: int = 0, blocks: int = 64, ratio: float = 1.25) -> DataFrame:
    """batch, n, longest, padding and keys: examples of one length range and block, in the epoch's order, as many as fit the budget.

    A batch of n examples is padded to its longest, of n * longest tokens at most budget (a single example may exceed it). As
    lengths within a range differ by the ratio at most, less than 1 - 1 / ratio of a batch is padding (of lengths from 1 / (ratio - 1) on).
    batch is block:range:number; a hash of it orders the epoch's batches. The last batch of a block and range may be short.
    """
    own = examples.withColumn("_draw", drawn(seed, epoch, key)).withColumns({"block": block_of("_draw", blocks), "range": length_range(length, ratio)})
    most = F.floor(F.pow(F.lit(ratio), F.col("range")) + 1e-9)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(most, F.lit(1)))).cast("int")
    within = F.row_number().over(Window.partitionBy("block", "range").orderBy("_draw", key)) - 1
    numbered = own.withColumn("_k", within).withColumn("_no", F.floor(F.col("_k") / fits).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("_k", F.col(key).alias("key"))))
    made = numbered.groupBy("block", "range", "_no").agg(F.count("*").cast("int").alias("n"), F.max(length).cast("int").alias("longest"), F.sum(length).cast("long").alias("_tokens"), F.transform(rows, lambda r: r["key"]).alias("keys"))
    padding = F.when(F.col("n") * F.col("longest") > 0, 1 - F.col("_tokens") / (F.col("n") * F.col("longest"))).otherwise(0.0)
    return made.select(F.concat_ws(":", "block", "range", "_no").alias("batch"), "n", "longest", padding.alias("padding"), "keys")


def in_batch_order(batched: DataFrame, seed: int, epoch: int = 0, blocks: int = 64) -> DataFrame:
    """Batches with block and place, in an order that seed and epoch give: ranges of lengths are mixed."""
    return epoch_of(batched, "batch", seed, epoch, blocks)


def loaders(corpora: DataFrame, split: str, order: str, key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Examples (corpus and others) as a split reads them, with block and place: train drawn anew each epoch from all corpora together;
    valid and test in order, a block a corpus; predict in order, one block."""
    if split == "train":
        return epoch_of(corpora, key, seed, epoch)
    if split in ("valid", "test"):
        place = F.row_number().over(Window.partitionBy("corpus").orderBy(order)) - 1
        return corpora.withColumns({"block": F.col("corpus"), "place": place})
    if split == "predict":
        from tsumugi.operators.numbering import numbered

        return numbered(corpora, [order], "place").withColumn("block", F.lit(0))
    raise ValueError(f"unknown split {split!r}")
