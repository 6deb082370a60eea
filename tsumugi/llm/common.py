"""What the operators of this subpackage share: reading, the shared folder, words, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit multipliers of the splitmix finaliser (fixed values).
MIX_1, MIX_2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[list[str], DataFrame]:
    """df's columns, but for some, as one struct "row" beside whatever is selected next: own names can't clash with them."""
    names = [c for c in df.columns if c not in without]
    return names, df.select(F.struct(*[df[c] for c in names]).alias("row"), *[df[c] for c in without if c in df.columns])


def giving_way(keys: list[str], results: list[str]) -> list[str]:
    """The keys but for those named like a result, which give way to it."""
    return [k for k in keys if k not in results]


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as no column of that name needs (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on a local master (tests)."""
    context = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if own is None and not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="tsumugi-"))
    return own or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder: what follows survives lost executors and has a short lineage.

    Spark's cleaner removes the files once the frame is no longer referenced, where that is switched on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: set[str] = set()


def tables_dir(spark: SparkSession) -> str:
    """This application's folder of tables, which is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if path not in _kept:
        _kept.add(path)
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        atexit.register(lambda: files.delete(at, True))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder: unlike cut(), its size on disk is then known to the optimizer."""
    path = f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """many joined with one, which has a row for each value of keys at most and, as count, how many rows of many have it.

    Keys with more rows than a shuffle partition's fair share, of which there can't be more than partitions, are dealt over
    all partitions: many's rows by a hash of all their columns, and one's row repeated for each. No other row is repeated.
    one is read twice: keep it stored.
    """
    parts = shuffle_partitions(many.sparkSession)
    share = (one.agg(F.sum(count)).first()[0] or 0) // parts + 1
    hot = [r[0] for r in one.where(F.col(count) > share).select(keys[0]).distinct().collect()]  # fewer than parts
    if not hot:
        return many.join(one.drop(count), keys)
    is_hot = F.col(keys[0]).isin(hot)
    salted = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(parts)).cast("int")).otherwise(0))
    every = one.drop(count).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, parts - 1).otherwise(0))))
    return salted.join(every, [*keys, "_salt"]).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() splits at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every n consecutive items (by doubling), not mixed; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out, done, part, width = None, 0, hashes, 1
    power = int(GOLDEN)
    with np.errstate(over="ignore"):
        while True:
            if n & width:  # append this part to the right of what there is
                piece = part[done : done + size]
                out = piece if out is None else out * np.uint64(power) + piece
                done += width
            if done == n:
                return out
            part = part[: len(part) - width] * np.uint64(power) + part[width:]
            power, width = power * power % 2**64, width * 2


def rows_of(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = 512, most_bytes: int = 16 << 20) -> Iterator[list[list]]:
    """Python lists of the named columns, a bounded number of rows and bytes at a time (one row at least)."""
    for batch in batches:
        step = max(1, min(most, int(most_bytes * max(1, batch.num_rows) / max(1, batch.nbytes))))
        at = [batch.schema.get_field_index(c) for c in columns]
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield [part.column(i).to_pylist() for i in at]
