import os
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row

from tsumugi.sources import sinks
from tsumugi.sources.text import raw_documents
from tsumugi.streaming import interactive


def test_documents_and_numbers(spark, tmp_path):
    """Documents that span batches come out whole, and as the batch plan cuts them."""
    interactive.use_rocksdb(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    parts = ["a\nb\nEOD\nc\n", "d\nEOD\n", "EOD\ne\n"]
    query = interactive.run(interactive.documents(interactive.file_lines(spark, str(folder))), lambda df: df, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"))
    try:
        for k, part in enumerate(parts):
            (folder / f"{k}.txt").write_text(part)
            query.processAllAvailable()
    finally:
        query.stop()
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("ord", "text").orderBy("ord").collect()]
    batch = raw_documents(spark.createDataFrame([("", "".join(parts) + "EOD")], "path string, text string")).select("ord", "text").orderBy("ord").collect()
    assert found == [(0, "a\nb"), (1, "c\nd"), (2, "")] == [tuple(r) for r in batch][:3]


def test_running_numbers(spark, tmp_path):
    interactive.use_rocksdb(spark)
    folder = tmp_path / "in"
    schema = "doc_id string, sent_ord int, text string, last boolean"
    spark.createDataFrame([("x", 0, "a", False), ("x", 1, "b", False), ("y", 0, "c", True)], schema).write.parquet(str(folder / "0"))
    read = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
    query = interactive.numbered_sentences(read).writeStream.format("memory").queryName("numbered").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([("x", 2, "d", True)], schema).write.parquet(str(folder / "1"))
        query.processAllAvailable()
        found = {r["sid"]: r["text"] for r in spark.sql("SELECT * FROM numbered").collect()}
    finally:
        query.stop()
    assert found == {"x-1": "a", "x-2": "b", "x-3": "d", "y-1": "c"}


ANALYSED = "doc_id string, win_idx long, ord long, sid string, analysis string, last boolean"


def streamed(spark, tmp_path, schema, batches, plan, wait=None):
    """The rows that a plan gives over batches that arrive one after the other; wait: until so many rows are there."""
    interactive.use_rocksdb(spark)
    folder, name = tmp_path / "in", f"s{abs(hash(str(tmp_path)))}"
    spark.createDataFrame([], schema).write.parquet(str(folder / "none"))
    read = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
    query = plan(read).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / str(k)))
            if wait is None:
                query.processAllAvailable()
        until = time.time() + 90
        while wait is not None and spark.table(name).count() < wait and time.time() < until:
            time.sleep(0.5)
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        query.stop()


def test_merged_sentences_of_the_earliest_window(spark, tmp_path):
    batches = [[("x", 1, 1, "s1", "second window", False), ("x", 0, 0, "s0", "a", False), ("x", 0, 1, "s1", "b", False), ("y", 0, 0, "t0", "c", True)], [("x", 2, 1, "s1", "late", False), ("x", 2, 3, "s2", "d", True)]]
    found = streamed(spark, tmp_path, ANALYSED, batches, interactive.merged_sentences)
    assert sorted(found) == [("x", 0, "s0", "a"), ("x", 1, "s1", "b"), ("x", 3, "s2", "d"), ("y", 0, "t0", "c")]


def test_a_document_without_an_end_is_given_when_it_is_idle(spark, tmp_path):
    batches = [[("x", 0, 1, "s1", "b", False), ("x", 0, 0, "s0", "a", False)]]
    found = streamed(spark, tmp_path, ANALYSED, batches, lambda df: interactive.merged_sentences(df, idle=1_000), wait=2)
    assert sorted(found) == [("x", 0, "s0", "a"), ("x", 1, "s1", "b")]


def test_a_document_is_given_when_the_next_one_begins(spark, tmp_path):
    schema = "source string, seq long, doc_id string, win_idx long, ord long, sid string, analysis string"
    batches = [
        [("s", 1, "x", 0, 0, "x0", "a"), ("s", 0, "w", 0, 0, "w0", "first"), ("r", 0, "x", 0, 0, "x0", "other source")],
        [("s", 2, "x", 1, 0, "x0", "late"), ("s", 3, "x", 1, 1, "x1", "b")],
        [("s", 4, "y", 0, 0, "y0", "c"), ("s", 5, "x", 0, 0, "x0", "again"), ("s", 6, "z", 0, 0, "z0", "never given")],
    ]
    found = streamed(spark, tmp_path, schema, batches, interactive.changed_documents)
    assert sorted(found) == [("w", 0, "w0", "first"), ("x", 0, "x0", "a"), ("x", 0, "x0", "again"), ("x", 1, "x1", "b"), ("y", 0, "y0", "c")]


def test_a_stream_killed_between_batches_gives_each_document_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.txt").write_text("".join(f"document {k} {j}\nEOD\n" for j in range(3)))
        os.utime(folder / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))  # files arrive in the order of their times
    interactive.use_rocksdb(spark)
    sinks.begin(spark, out, state)

    def run(dies_after):
        def sink(batch, epoch):
            sinks.append_epoch(batch, epoch, out, ["source", "ord"])
            if epoch == dies_after:
                raise RuntimeError("killed after its output was written")

        query = interactive.run(interactive.documents(interactive.file_lines(spark, str(folder))), lambda df: df, sink, state)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for dies_after in (0, 2):
        with pytest.raises(StreamingQueryException):
            run(dies_after)
        sinks.begin(spark, out, state)
    run(None)
    lines = [(r["epoch"], r["ord"], r["line"]) for r in sinks.read_epochs(spark, out).orderBy("epoch", "ord").collect()]
    assert [x[2] for x in lines] == [f"document {k} {j}" for k in range(4) for j in range(3)] and [x[:2] for x in lines] == [(k, j) for k in range(4) for j in range(3)]
    (tmp_path / "fresh").mkdir()
    sinks.begin(spark, out, str(tmp_path / "other state"))
    assert not (tmp_path / "out").exists()


class MapState:
    """A map state in memory that counts what it is asked."""

    def __init__(self):
        self.own, self.asked = {}, 0

    def __getattribute__(self, name):
        if name not in ("own", "asked"):
            self.asked += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.own)

    def containsKey(self, key):
        return key in self.own

    def getValue(self, key):
        return self.own[key]

    def updateValue(self, key, value):
        self.own[key] = value

    def iterator(self):
        return iter(list(self.own.items()))

    def clear(self):
        self.own.clear()


def test_a_document_that_comes_whole_hardly_asks_the_state():
    rng = random.Random(5)
    rows = [Row(doc_id="x", win_idx=w, ord=k, sid=f"s{k}", analysis=f"{k} {w}", last=False) for k in range(40) for w in rng.sample(range(5), 3)]
    rng.shuffle(rows)
    rows.append(Row(doc_id="x", win_idx=9, ord=40, sid="s40", analysis="40 9", last=True))
    least = {k: min(r.win_idx for r in rows if r.ord == k) for k in range(41)}
    for cuts in ([], [1], [30, 80], list(range(1, len(rows)))):
        merger = interactive.SentenceMerger()
        merger.state = state = MapState()
        calls = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        found = [[tuple(r) for r in merger.handleInputRows(("x",), iter(c), None)] for c in calls]
        assert not any(found[:-1]) and found[-1] == [("x", k, f"s{k}", f"{k} {least[k]}") for k in range(41)] and not state.own
        assert cuts or state.asked == 1


def test_an_epoch_s_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    batch = spark.range(100, numPartitions=3).mapInPandas(counted, "id long").selectExpr("100 - id AS ord", "cast(id AS string) AS text")
    sinks.append_epoch(batch, 0, str(tmp_path / "out"), ["ord"])
    assert [r["line"] for r in sinks.read_epochs(spark, str(tmp_path / "out")).orderBy("ord").collect()] == [str(k) for k in reversed(range(100))]
    assert seen.value == 100
