"""The interactive loop as a stream: lines are buffered to a document's end mark, then the batch plan runs on each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType([StructField("source", StringType()), StructField("ord", LongType()), StructField("text", StringType())])
BUFFER = StructType([StructField("n", LongType()), StructField("text", StringType())])
NUMBERED = StructType([StructField("doc_id", StringType()), StructField("n", LongType()), StructField("sid", StringType()), StructField("text", StringType())])


class DocumentBuffer(StatefulProcessor):
    """Keeps a source's lines since the last end mark; gives a document at each. What has no end mark yet waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", BUFFER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, text = self.state.get() if self.state.exists() else (0, "")
        out = []
        lines = pd.concat(list(rows)).sort_values("line_no")["line"].tolist()
        for line in lines:
            if line.strip() == "EOD":
                out.append((key[0], n, text.rstrip()))
                n, text = n + 1, ""
            else:
                text += line + "\n"
        self.state.update((n, text))
        yield pd.DataFrame(out, columns=DOCUMENT.names)

    def close(self) -> None:
        pass


class SentenceCounter(StatefulProcessor):
    """Numbers a document's sentences from 1 on across batches; the state goes when its last sentence has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("n", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.state.get()[0] if self.state.exists() else 0
        frame = pd.concat(list(rows)).sort_values("sent_ord")
        numbers = range(n + 1, n + 1 + len(frame))
        if bool(frame["last"].any()):
            self.state.clear()
        else:
            self.state.update((n + len(frame),))
        yield pd.DataFrame({"doc_id": key[0], "n": list(numbers), "sid": [f"{key[0]}-{k}" for k in numbers], "text": frame["text"].tolist()}, columns=NUMBERED.names)

    def close(self) -> None:
        pass


MERGED = StructType([StructField("doc_id", StringType()), StructField("ord", LongType()), StructField("sid", StringType()), StructField("analysis", StringType())])
KEPT = StructType([StructField("win_idx", LongType()), StructField("ord", LongType()), StructField("analysis", StringType())])


Found = dict[str, tuple[int, int, str]]


class SentenceMerger(StatefulProcessor):
    """Keeps one analysis of each of a document's sentences, that of the earliest window; gives them in order, and forgets them, at its end.

    The end is a row marked last. idle: after how many milliseconds without a row a document that has no end is given and
    forgotten too (None: never); rows that come later are a document of their own. What a call brings is merged in
    Python first: the state, which costs a round trip each time, is read and written only for documents that span micro-batches.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("sentences", StructType([StructField("sid", StringType())]), KEPT)

    def take(self, found: Found, row) -> None:
        if row.sid not in found or found[row.sid][0] > row.win_idx:
            found[row.sid] = (row.win_idx, row.ord, row.analysis)

    def keep(self, found: Found) -> None:
        """found into the state, for a later call."""
        known = self.state.exists()
        for sid, own in found.items():
            if not known or not self.state.containsKey((sid,)) or self.state.getValue((sid,))[0] > own[0]:
                self.state.updateValue((sid,), own)

    def given(self, doc_id: str, found: Found) -> Iterator[Row]:
        """The document's sentences, of earlier calls and found; the state is empty afterwards."""
        if self.state.exists():
            for (sid,), own in self.state.iterator():
                if sid not in found or found[sid][0] >= own[0]:
                    found[sid] = tuple(own)
            self.state.clear()
        for place, sid, analysis in sorted((own[1], sid, own[2]) for sid, own in found.items()):
            yield Row(doc_id=doc_id, ord=place, sid=sid, analysis=analysis)

    def wait(self, timers) -> None:
        """A timer from now on, instead of those that are set."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (list, tuple)) else t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: Found = {}
        ended = False
        for row in rows:
            self.take(found, row)
            ended = ended or bool(row.last)
        if ended:
            yield from self.given(key[0], found)
            return
        self.keep(found)
        if self.idle is not None:
            self.wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.given(key[0], {})

    def close(self) -> None:
        pass


class DocumentChange(SentenceMerger):
    """The same for a source whose documents come one after the other: a row of another document ends the one before.

    Rows are taken by their place in the source (seq). A document that comes back later is another one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("doc_id", StructType([StructField("doc_id", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.now.get()[0] if self.now.exists() else None
        found: Found = {}
        for row in sorted(rows, key=lambda r: r.seq):
            if now is not None and row.doc_id != now:
                yield from self.given(now, found)
                found = {}
            now = row.doc_id
            self.take(found, row)
        self.keep(found)
        self.now.update((now,))
        if self.idle is not None:
            self.wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.now.exists():
            now = self.now.get()[0]
            self.now.clear()
            yield from self.given(now, {})


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def documents(lines: DataFrame) -> DataFrame:
    """A stream of lines (source, line_no, line) as documents (source, ord, text)."""
    return lines.groupBy("source").transformWithStateInPandas(DocumentBuffer(), DOCUMENT, "Append", "None")


def numbered_sentences(sentences: DataFrame) -> DataFrame:
    """A stream of sentences (doc_id, sent_ord, text, last) with their numbers and ids."""
    return sentences.groupBy("doc_id").transformWithStateInPandas(SentenceCounter(), NUMBERED, "Append", "None")


def merged_sentences(analysed: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of analysed sentences of windows (doc_id, win_idx, ord, sid, analysis, last) as each document's sentences, once each."""
    return analysed.groupBy("doc_id").transformWithState(SentenceMerger(idle), MERGED, "Append", "None" if idle is None else "ProcessingTime")


def changed_documents(analysed: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of analysed sentences of sources (source, seq, doc_id, win_idx, ord, sid, analysis) as documents, each when the next one begins."""
    return analysed.groupBy("source").transformWithState(DocumentChange(idle), MERGED, "Append", "None" if idle is None else "ProcessingTime")


def file_lines(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Lines of files as they arrive in a folder: the file's folder-wide stream is one source, in order of arrival."""
    read = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path, wholetext=True)
    each = read.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "line"))
    return each.select(F.lit("stdin").alias("source"), "line_no", "line")


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of documents through the batch plan, then to the sink. The query restarts from its checkpoint."""

    def one(batch: DataFrame, epoch: int) -> None:
        sink(plan(batch), epoch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
