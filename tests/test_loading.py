"""Loaders: every example once an epoch, another order for another seed or epoch, batches within their budget."""

import pytest
from pyspark.sql import functions as F

from tsumugi.operators import loading


@pytest.fixture(scope="module")
def examples(spark):
    return spark.range(3_000).select(F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(400)) + 1).cast("int").alias("n_tokens"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("corpus")).repartition(5)


def order(df):
    return [r["key"] for r in df.orderBy("block", "place").collect()]


def test_epochs(spark, examples):
    one, again, other, later = (order(loading.epoch_of(examples, "key", s, e)) for s, e in ((1, 0), (1, 0), (2, 0), (1, 1)))
    assert sorted(one) == sorted(other) == sorted(later) == list(range(3_000))
    assert one == again and one != other and one != later and one != sorted(one)
    sizes = [r["count"] for r in loading.epoch_of(examples, "key", 1).groupBy("block").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 3 * 3_000 / 64
    assert loading.epoch_of(examples.limit(0), "key", 1).count() == 0


def test_batches(spark, examples):
    rows = loading.batches(examples, "key", "n_tokens", 1_000, seed=3, blocks=4).collect()
    lengths = {r["key"]: r["n_tokens"] for r in examples.collect()}
    assert sorted(k for r in rows for k in r["keys"]) == list(range(3_000))
    for r in rows:
        own = [lengths[k] for k in r["keys"]]
        assert r["n"] == len(own) and r["longest"] == max(own) and r["n"] * r["longest"] <= 1_000
        assert abs(r["padding"] - (1 - sum(own) / (len(own) * max(own)))) < 1e-9 and (r["padding"] < 0.2 or max(own) < 4)
    padded = sum(r["n"] * r["longest"] for r in rows)
    assert sum(lengths.values()) / padded > 0.88
    mixed = loading.in_batch_order(loading.batches(examples, "key", "n_tokens", 1_000, seed=3, blocks=4), seed=3)
    assert mixed.count() == len(rows) and mixed.select("block", "place").distinct().count() == len(rows)


def test_an_example_over_the_budget_is_a_batch(spark):
    df = spark.createDataFrame([("x", 50), ("y", 3), ("z", 0), ("w", 1)], "key string, n_tokens int")
    rows = {tuple(r["keys"]): (r["n"], r["longest"], r["padding"]) for r in loading.batches(df, "key", "n_tokens", 10, seed=1, blocks=1).collect()}
    assert rows[("x",)] == (1, 50, 0.0) and rows[("y",)] == (1, 3, 0.0) and {k for r in rows for k in r} == {"x", "y", "z", "w"}


def test_length_ranges(spark):
    found = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8, 9, 16, 17)], "n int").select("n", loading.length_range("n", 2.0).alias("k")).collect()}
    assert found == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 8: 3, 9: 4, 16: 4, 17: 5}


def test_loaders_of_splits(spark, examples):
    assert order(loading.loaders(examples, "train", "key", "key", seed=5)) == order(loading.epoch_of(examples, "key", 5))
    valid = loading.loaders(examples, "valid", "key", "key")
    assert [r["key"] for r in valid.where("block = 'a'").orderBy("place").collect()] == list(range(0, 3_000, 3))
    assert order(loading.loaders(examples, "predict", "key", "key")) == list(range(3_000))
    with pytest.raises(ValueError):
        loading.loaders(examples, "other", "key", "key")
