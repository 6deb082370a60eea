"""The queries against their SQL, as the driver compares them, on the smallest tables."""

import os

import pytest

from tsumugi import queries, queries_more, queries_stages  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def as_rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr([x.tolist() if hasattr(x, "tolist") else x for x in row]) for row in frame.to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert found.count() > 0
        return
    mine, own = found.toPandas(), duck.execute(queries.ORACLES[name]).df()
    columns = sorted(own.columns)
    assert sorted(mine.columns) == columns and as_rows(mine, columns) == as_rows(own, columns)
