"""Numbers over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.sources.shared import kept


def numbered(rows: DataFrame, order: list[Column | str], name: str, total: str | None = None) -> DataFrame:
    """rows with their number from 0 in the given order (long), and their count as total if that is named.

    The rows are dealt out by ranges of all columns of the order and, where those tie, of where a row was read, so that neither nulls
    (first) nor frequent values nor equal rows make a range large, and kept in the shared folder, since ranges are drawn anew each time; each range is numbered on its own, from
    where the ranges before it end. Rows that are equal in the order come one after the other, in any order. Columns
    named _tie, _part, _before and _within must not be among rows'.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = kept(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie").drop("_tie").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    counted = [F.sum("_n").over(Window.partitionBy()).alias(total)] if total else []
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), *counted)
    within = ranged.withColumn("_within", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def padded(number: Column, width: Column) -> Column:
    """A number as text with zeros in front, as long as width; a longer number stays whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0"))
