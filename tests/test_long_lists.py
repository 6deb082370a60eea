"""Look-ups whose results are long: the words of a form stand together, in parts of bounded size."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tsumugi import queries
from tsumugi.operators import lexicon

DATA = "/root/testdata"


def runs(df, column):
    """Runs of equal values within partitions, and distinct pairs of a partition and a value."""
    rows = [tuple(r) for r in df.select(F.spark_partition_id(), column).collect()]
    return sum(a != b for a, b in zip(rows, [None, *rows], strict=False)), len(set(rows))


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("part", [1 << 33, 200])
def test_a_form_in_parts(spark, monkeypatch, threshold, part):
    """As by_form(), whatever the join; a form that makes more than a part is in several, and all words have their results."""
    monkeypatch.setattr(lexicon, "PART_BYTES", part)
    rows = [(k, f"f{k % 3}" if k % 10 else None, "n") for k in range(300)] + [(900, "rare", None), (901, None, None), (None, "f1", "n")]
    words = spark.createDataFrame(rows, "key long, norm string, pos string").repartition(3)
    found = lambda forms: forms.withColumn("meanings", F.concat_ws(" ", F.coalesce("norm", F.lit("-")), F.lit("x" * 20)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        own = lexicon.by_long_form(words, found, F.octet_length("meanings"))
        assert own.columns == ["key", "meanings"]
        n_runs, n_distinct = runs(own, "meanings")
        expected = {(k, f"{f or '-'} {'x' * 20}") for k, f, _ in rows if k is not None}
        got = [(r["key"], r["meanings"]) for r in own.where("key is not null").collect()]
        assert set(got) == expected and len(got) == len(expected) and own.where("key is null").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n_runs == n_distinct
    assert part > 1000 or n_distinct > 6  # three forms and null, dealt over partitions


def copied(part, n):
    return part.crossJoin(part.sparkSession.range(n)).withColumn("p_partkey", F.col("p_partkey") + 10**6 * F.col("id")).drop("id")


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="the driver's tables aren't here")
def test_lists_are_stored_once_a_form(spark, tmp_path):
    """Six copies of part: what Parquet takes follows the lists (some 700 MB of text, 31 MB of Parquet where words of a form stood apart)."""
    copied(spark.read.parquet(f"{DATA}/sf0.1/part.parquet"), 6).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    queries.dict_lookup(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet"))) < 4_000_000


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="the driver's tables aren't here")
def test_rows_are_those_of_the_sql_where_names_are_missing(spark, tmp_path):
    import duckdb

    part = spark.read.parquet(f"{DATA}/sf0.01/part.parquet")
    odd = part.limit(2).withColumns({"p_partkey": F.col("p_partkey") + 10**9, "p_name": F.lit(None).cast("string")})
    copied(part, 4).unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    queries.dict_lookup(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    expected = sorted(connection.execute(queries.ORACLES["dict_lookup"]).fetchall())
    assert sorted(connection.execute(f"SELECT key, meanings, n FROM '{tmp_path}/out/*.parquet'").fetchall()) == expected
