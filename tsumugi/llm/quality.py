"""Quality classifier (operator 2): a factorisation machine over hashed words, structure statistics and metadata.

The score is a sigmoid of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the last sum is, for each factor f,
half of (sum v_if x_i)^2 - sum v_if^2 x_i^2, so that it takes time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import giving_way, unused, word_hashes

#: Hashed words, bytes that are counted one by one, and other statistics.
BUCKETS = 1024
MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789", np.uint8)
N_STATS = len(MARKS) + 14
SIZE = BUCKETS + N_STATS
THRESHOLD = 0.3
#: Labelled rows to fit on, at most, by a hash of their doc_id: a documented bound that the fit on the driver needs.
MOST_ROWS = 6000


def features(text: str | None) -> np.ndarray:
    """Hashed words (log counts, of length 1 together) and statistics of a whole text; metadata is its length."""
    out = np.zeros(SIZE, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = data.split()
    words = data.lower().split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n, n_words = max(1, len(data)), max(1, len(words))
    stats = out[BUCKETS:]
    stats[: len(MARKS)] = np.log1p(1000 * counts[MARKS] / n)
    upper, lower, space = counts[65:91].sum(), counts[97:123].sum(), counts[[9, 10, 11, 12, 13, 32]].sum()
    hashed = word_hashes(words)
    _, repeats = np.unique(hashed, return_counts=True)
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    sizes = np.fromiter(map(len, raw), np.float64, len(raw)) if raw else np.zeros(1)
    again = float((hashed[1:] == hashed[:-1]).mean()) if len(hashed) > 1 else 0.0
    marked = counts[MARKS[:32]].sum()
    stats[len(MARKS) :] = (
        np.log1p(len(data)), np.log1p(len(words)), upper / n, lower / n, space / n, counts[128:].sum() / n, marked / n, sizes.mean() / 10, sizes.std() / 10,
        len(repeats) / n_words, (repeats.max() / n_words if len(repeats) else 0.0), again, len(set(filled)) / max(1, len(filled)), np.log1p(len(words) / max(1, len(filled))),
    )
    if len(words):
        found = np.log1p(np.bincount((hashed & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS))
        out[:BUCKETS] = found / np.sqrt((found**2).sum())
    return out


class Machine:
    """w0, w and v of a factorisation machine, and the scale of its statistics."""

    def __init__(self, factors: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, factors)).astype(np.float32)
        self.mean, self.scale = np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -4, 4) / 4
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 800, rate: float = 0.015, decay: float = 1e-4, batch: int = 256, seed: int = 11) -> Machine:
        """Adam on the log loss, as many steps for any number of rows. With one label only, or none, the score is that label's smoothed share."""
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if len(np.unique(y)) < 2:
            self.v[:] = 0
            return self
        self.mean, self.scale = x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + 1e-3
        x = self.scaled(x)
        x2 = x * x
        rng = np.random.default_rng(seed)
        first = [np.zeros(1), np.zeros_like(self.w), np.zeros_like(self.v)]
        second = [np.zeros(1), np.zeros_like(self.w), np.zeros_like(self.v)]
        order = np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(y))
            b, order = order[:batch], order[batch:]
            now = rate * (1 - 0.9 * step / steps)
            xb, squares = x[b], x2[b]
            product = xb @ np.column_stack([self.w, self.v])
            xv = product[:, 1:]
            logits = self.w0 + product[:, 0] + 0.5 * ((xv * xv).sum(axis=1) - squares @ (self.v * self.v).sum(axis=1))
            g = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[b]) / len(b)).astype(np.float32)
            down = xb.T @ np.column_stack([g, g[:, None] * xv])
            grads = [np.array([g.sum()]), down[:, 0] + decay * self.w, down[:, 1:] - (squares.T @ g)[:, None] * self.v + decay * self.v]
            for k, (d, value) in enumerate(zip(grads, (None, self.w, self.v), strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                move = now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                if value is None:
                    self.w0 -= float(move[0])
                else:
                    value -= move.astype(np.float32)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, SIZE), np.float32)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.scaled(x)).astype(np.float64), -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a row without an id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Machine:
    """A machine fitted on labelled documents that aren't held out: at most most_rows of them, by a hash of their doc_id.

    Nulls among ids or labels are left out; without labelled rows the machine scores every text alike. Features are
    made on the executors; a row of them has a fixed size, so what comes to the driver is bounded by most_rows.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("_y")).where("doc_id is not null and _y is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.BinaryType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()).astype("<f2").tobytes() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(made, pa.binary())], names=schema.names)

    made = rows.select("doc_id", "_y", "_text").mapInArrow(kernel, schema)
    found = made.orderBy("doc_id", "x").limit(most_rows).toArrow()  # a doc_id may have several rows
    machine = Machine()
    if not found.num_rows:
        return machine.fit(np.zeros((0, SIZE), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), "<f2").reshape(-1, SIZE).astype(np.float32)
    y, ids = found.column("y").to_numpy(), found.column("doc_id").to_numpy()
    order = np.lexsort((x.sum(axis=1), ids))
    return machine.fit(x[order], y[order])


def score_documents(docs: DataFrame, machine: Machine, keys: list[str], text: str = "text") -> DataFrame:
    """keys and score (0 to 1) of each row of docs, in one pass without a shuffle; null texts score as empty ones.

    Repeated rows give repeated results, an empty table none; other columns aren't read; a key named like the result gives way.
    """
    keys = giving_way(keys, ["score"])
    one = docs.select(*[docs[k].alias(k) for k in keys], docs[text].alias(unused("_text", keys)))
    schema = T.StructType([*one.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[float] = []
            for start in range(0, batch.num_rows, 128):
                part = batch.column(batch.num_columns - 1).slice(start, 128)
                found.extend(machine.scores(part.to_pylist()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=names)

    return one.mapInArrow(kernel, schema)


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold; in one pass without a shuffle.

    Null texts are scored as empty ones; repeated rows stay or go together; a score equal to the threshold stays; an empty
    table gives none.
    """
    at = docs.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            for start in range(0, batch.num_rows, 128):
                good.extend((machine.scores(batch.column(at).slice(start, 128).to_pylist()) >= threshold).tolist())
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
