"""Rows dealt out by a key, in as many parts as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part at most (on average), and at least where there are fewer parts than Spark's own.
MOST_ROWS, LEAST_ROWS = 200_000, 20_000


def parts_for(n_rows: int, usual: int) -> int:
    """How many parts n_rows rows get: the usual number, fewer for few rows, and more for many, so that a part doesn't grow with its input."""
    return max(1, min(usual, n_rows // LEAST_ROWS), -(-n_rows // MOST_ROWS))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with those of equal keys in one part, for windows, groups and joins by the keys, or by these and others, which then shuffle no more.

    The rows are counted first: this is for tables, whose files know their number.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(parts_for(rows.count(), usual), *[F.col(k) for k in keys])
