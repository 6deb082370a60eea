"""Raw documents by byte ranges: a file of many ranges gives the rows of a whole read."""

import random

import pytest

from tsumugi.sources.splits import range_lines, read_raw_splits
from tsumugi.sources.text import raw_documents, whole_files


def rows(df):
    return sorted((r["path"].rsplit("/", 1)[-1], r["ord"], r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def odd_file(seed):
    rng = random.Random(seed)
    parts = []
    for d in range(rng.randrange(1, 14)):
        lines = [rng.choice(["犬と猫", "a", "", "  ", "EODx", "x EOD", "long line of text " * 9]) for _ in range(rng.randrange(12))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), f"# D-ID:d{d}")
        parts.append("".join(x + "\n" for x in lines) + rng.choice(["EOD\n", "EOD\n", " EOD \n", "EOD\nEOD\n"]))
    return "".join(parts) + rng.choice(["", "tail without a mark", "\n \n", "EOD"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_give_the_rows_of_a_whole_read(spark, tmp_path, small_ranges, seed):
    for k in range(6):
        (tmp_path / f"{k}.txt").write_text(odd_file(seed * 10 + k))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "one.txt").write_text("one document over many ranges\n" * 40 + "EOD\n" + "and a tail\n" * 30)
    assert range_lines(spark, str(tmp_path)).select("path", "start").distinct().count() > 30
    assert rows(read_raw_splits(spark, str(tmp_path))) == rows(raw_documents(whole_files(spark, str(tmp_path))))


def test_no_documents(spark, tmp_path, small_ranges):
    (tmp_path / "blank.txt").write_text("\n \n\n" * 40)
    assert read_raw_splits(spark, str(tmp_path)).count() == 0
