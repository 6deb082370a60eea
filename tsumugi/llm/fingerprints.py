"""Document fingerprints (operator 1): SimHash over weighted terms, and a search by permuted block tables.

A document's terms are its lower-cased words and pairs of neighbouring words; a term that occurs n times weighs
1 + floor(log2 n). Each term's hash bits vote with that weight, + for a 1 and - for a 0; a fingerprint bit is 1 where the
vote is positive. Near documents differ in few bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import GOLDEN, cut, giving_way, mix, shuffle_partitions, unused, word_hashes

#: 64-bit lanes of a fingerprint.
LANES = 2
#: Bits in which two fingerprints may differ for the search of the query.
RADIUS = 3
#: Terms that vote in one matrix.
STEP = 1 << 15


def simhash(text: str | None) -> np.ndarray:
    """The fingerprint's lanes as uint64; all 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(LANES, np.uint64)
    single = word_hashes(words)
    with np.errstate(over="ignore"):
        terms, counts = np.unique(np.concatenate([mix(single), mix(single[:-1] * GOLDEN + single[1:])]), return_counts=True)
        weights = (np.floor(np.log2(counts)) + 1).astype(np.float32)
        votes = np.zeros((LANES, 64))
        for start in range(0, len(terms), STEP):
            part, w = terms[start : start + STEP], weights[start : start + STEP]
            for lane in range(LANES):
                bits = np.unpackbits(mix(part + np.uint64(lane + 1) * GOLDEN).astype(">u8").view(np.uint8)).reshape(-1, 64)
                votes[lane] += 2.0 * (w @ bits.astype(np.float32)).astype(np.float64) - float(w.sum(dtype=np.float64))
    return np.packbits(votes > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def as_hex(lanes: np.ndarray) -> str:
    return "".join(f"{x:016x}" for x in lanes.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bits in which two fingerprints agree."""
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / (64 * LANES)


def fingerprint_documents(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fingerprint (32 hex digits) of each row of docs, in one pass without a shuffle.

    Null and empty texts, and those of white space only, have the fingerprint of 32 zeros. Equal texts have equal
    fingerprints. Texts of any length are read whole; repeated rows give repeated results; other columns aren't read.
    A key named like the result gives way.
    """
    keys = giving_way(keys, ["fingerprint"])
    one = docs.select(*[docs[k].alias(k) for k in keys], docs[text].alias(unused("_text", keys)))
    schema = T.StructType([*one.schema.fields[:-1], T.StructField("fingerprint", T.StringType())])
    names = [f.name for f in schema.fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_hex(simhash(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=names)

    return one.mapInArrow(kernel, schema)


def lanes_of(prints: Column, name: str) -> list[Column]:
    """A fingerprint in hex as numbers of 32 bits, worked out once: comparisons of pairs then make no objects."""
    return [F.conv(F.substring(prints, 8 * k + 1, 8), 16, 10).cast("long").alias(f"{name}_{k}") for k in range(2 * LANES)]


def block_of(prints: str, k: int, blocks: int) -> Column:
    """The k-th of a fingerprint's blocks; the last has the rest."""
    width = 16 * LANES // blocks  # hex digits
    return F.substring(prints, width * k + 1, width if k < blocks - 1 else 16 * LANES)


def search(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (query, found, distance) of fingerprints at most radius bits apart.

    A fingerprint is cut into radius + 1 blocks. Those that differ in at most radius bits agree in one block at least, so as
    many tables, each permuted to begin with another block and keyed by it, find them all: an equi-join on (table, block), whose
    rows are then compared; a pair counts in the first of its tables. Equal fingerprints count once on either side (join
    documents to the result by their fingerprint); nulls are ignored; an empty side gives no pairs. radius is 15 at most.
    Rows of a block that many fingerprints share are dealt over all partitions.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must be 0 to 15")

    blocks = radius + 1

    def tables(df: DataFrame, name: str) -> DataFrame:
        """One row for each table, keyed by the block that it begins with (its number in front)."""
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct().select(name, *lanes_of(F.col(name), name))
        keys = F.array(*[F.concat(F.lit(f"{k}:"), block_of(name, k, blocks)) for k in range(blocks)])
        return one.select("*", F.posexplode(keys).alias(f"{name}_table", "_block")).drop("query_table")

    asked, known = tables(queries, "query"), tables(index, "found")
    parts = shuffle_partitions(index.sparkSession)
    crowd = known.join(asked.select("_block").distinct(), "_block", "left_semi").groupBy("_block").agg(F.count("*").alias("n"))
    share = (crowd.agg(F.sum("n")).first()[0] or 0) // parts + 1
    hot = [r[0] for r in crowd.where(F.col("n") > share).select("_block").collect()]  # fewer than parts
    is_hot = F.col("_block").isin(hot) if hot else F.lit(False)
    dealt = known.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("found"), F.lit(parts)).cast("int")).otherwise(0))
    every = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, parts - 1).otherwise(0))))
    differing = sum((F.bit_count(F.col(f"query_{k}").bitwiseXOR(F.col(f"found_{k}"))) for k in range(1, 2 * LANES)), F.bit_count(F.col("query_0").bitwiseXOR(F.col("found_0"))))
    before = F.lit(True)  # no table before this one has the pair
    for k in range(blocks - 1):
        before = before & ((F.col("found_table") <= k) | (block_of("query", k, blocks) != block_of("found", k, blocks)))
    pairs = dealt.join(every, ["_block", "_salt"]).withColumn("distance", differing)
    return pairs.where((F.col("distance") <= radius) & before).select("query", "found", "distance")


EDITED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]]
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is that of the next smaller doc_id; after the smallest comes the largest. In the edited text the
    last third (floor) of the code points gives way to the first as many (or all) of the next document's. Documents of one
    doc_id follow each other by text; those without a doc_id stand outside this order, each its own next. A null
    text counts as empty; an empty table gives no rows; a single document is its own next.

    The ids are cut into ranges at sampled ids, and the document at each cut also goes to the range above, so that each
    range is worked through in order by one task, on its own: one shuffle of the texts, no global order.
    """
    n = shuffle_partitions(docs.sparkSession)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = one.agg(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n)], 100 * n)).first()[0]
    cuts = np.unique(np.array([x for x in found or [] if x is not None], dtype=np.int64))

    def part_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        known = np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), hashes.to_numpy() % n, known), pa.int32())

    part_of = F.arrow_udf(part_of, "int")

    own = one.withColumn("part", part_of("doc_id", F.xxhash64("text"))).withColumn("copy", F.lit(False))
    bounds = one.where(F.col("doc_id").isin([int(x) for x in cuts])) if len(cuts) else one.limit(0)
    copies = bounds.withColumn("part", ((part_of("doc_id", F.lit(0).cast("long")) + 1) % F.lit(max(1, len(cuts)))).cast("int")).withColumn("copy", F.lit(True))
    ordered = own.unionByName(copies).repartitionById(n, "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, doc_id, text, fingerprint) of the row that waits for its next
        for batch in batches:
            out: list[tuple] = []
            for row in zip(batch.column("part"), batch.column("copy"), batch.column("doc_id"), batch.column("text"), strict=True):
                part, copy, doc_id, text = (x.as_py() for x in row)
                if doc_id is None:
                    lanes = simhash(text)
                    out.append(edited((part, None, text, lanes), text, lanes))
                    continue
                if copy and last is None:
                    continue
                if last is not None and last[0] != part:
                    out.append(edited(last, "", np.zeros(LANES, np.uint64)))
                    last = None
                    if copy:
                        continue
                own = simhash(text)
                if last is not None:
                    out.append(edited(last, text, own))
                last = None if copy else (part, doc_id, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(EDITED.names, r, strict=True)) for r in out], schema=ARROW)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(EDITED.names, edited(last, "", np.zeros(LANES, np.uint64)), strict=True))], schema=ARROW)

    return ordered.mapInArrow(kernel, EDITED)


def with_near(found: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """found (doc_id, fingerprint and others; kept once) with n_near: for the rows whose doc_id is divisible by `every`, how
    many rows have a fingerprint at most radius bits from theirs, their own included; null for the others.
    """
    found = cut(found)
    counts = found.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = found.where(F.col("doc_id") % every == 0).select("doc_id", "fingerprint").distinct()
    pairs = search(asked, found.select("fingerprint"), radius)
    near = pairs.join(counts.withColumnRenamed("fingerprint", "found"), "found").groupBy("query").agg(F.sum("n").alias("n_near"))
    by_id = asked.join(near, asked["fingerprint"] == near["query"]).select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"), "n_near")
    both = (found["doc_id"] == by_id["_id"]) & (found["fingerprint"] == by_id["_print"])
    return found.where(F.col("doc_id") % every == 0).join(by_id, both).select(*[found[c] for c in found.columns], "n_near").unionByName(found.where(~F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")))


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(row: tuple, after: str, next_lanes: np.ndarray) -> tuple:
    _, doc_id, text, lanes = row
    k = len(text) // 3
    changed = text[: len(text) - k] + after[:k]
    other = simhash(changed) if changed != text else lanes
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(lanes), as_hex(other), likeness(lanes, other), likeness(lanes, next_lanes)
