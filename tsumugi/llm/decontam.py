"""Benchmark decontamination (operator 7): size-partitioned MinHash containment search, verified on exact shingles.

An item with n distinct shingles is contained in a document if at least t n of them occur there. So of any n - ceil(t n) + 1
of its shingles one occurs, and the item's MinHash sketch is just that many of its least hashes: a sketch whose length follows
the item's size, with which no contained item is missed, however long the document. Items are partitioned by size; of a
document only the partitions that it is large enough for matter, and of its hashes those below the partitions' largest
sketch value. Items are dealt into blocks of bounded size, and a hash leads from a text to the blocks of the items that have it: a
text and all items of a block are compared at once, on their shingles as words, so no pair of a text and an item is ever a row.
(Classic MinHash signatures on the document's side would lose short items in long documents, whose Jaccard similarity is
next to 0.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import GOLDEN, hot_join, mix, packed, rolling, rows_of, shuffle_partitions, stored

SHINGLE, THRESHOLD = 5, 0.8
#: The size of the filter that spares most documents and hashes what follows: for each hash, and at most (8 MB).
BITS_A_HASH, MOST_BITS = 1024, 1 << 26
#: Characters of the items of a block, which a task holds the shingles of.
BLOCK_CHARS = 1 << 20
find_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return find_words(text.lower()) if text else []


def shingle_set(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def shingle_hashes(words: list[str], widths: list[int]) -> np.ndarray:
    """Distinct hashes of the shingles of the given widths."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return np.unique(np.concatenate([np.empty(0, np.uint64), *[mix(rolling(own, n) + np.uint64(n) * GOLDEN) for n in widths]]))


def needed(n: int, threshold: float) -> int:
    """How many of n shingles must occur: ceil(threshold n), safe from rounding."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


SKETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "hash")] + [T.StructField(n, T.IntegerType()) for n in ("width", "size_class")])


def sketches(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """item_id, hash, width and size class (log2 of the size) of each item's least hashes; unsigned hashes as longs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                width = min(shingle, len(words))
                found = shingle_hashes(words, [width])
                sketch = np.sort(found)[: len(found) - needed(len(found), threshold) + 1]
                out.extend((item, h, width, len(found).bit_length() - 1) for h in sketch.view(np.int64).tolist())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=SKETCH.names)

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(kernel, SKETCH)


def filter_bits(sketch: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the sketches' hashes as bytes, and its number of bits: BITS_A_HASH for each hash, MOST_BITS at most (a full one lets all pass)."""
    size = min(MOST_BITS, 1 << max(16, int(sketch.count() * BITS_A_HASH).bit_length()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in places_of(batch.column("hash").to_numpy().view(np.uint64), size):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in sketch.select("hash").coalesce(8).mapInArrow(kernel, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out.tobytes(), size


def places_of(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's two places in a filter of that many bits (a power of 2)."""
    return hashes & np.uint64(size - 1), (hashes >> np.uint64(26)) & np.uint64(size - 1)


KEY = ["text_hash", "other"]


def suspects(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that may contain an item (doc_id, text_hash, other, text), and the blocks of such items (text_hash, other, block).

    text_hash and other are 128 bits of the text. Each text is read once; a size class of items matters only to texts with
    as many distinct shingles as its smallest item needs.
    """
    sketch = stored(sketches(items, shingle, threshold))
    block = block_of(items)
    classes = sketch.groupBy("width", "size_class").agg(F.max(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))).alias("top")).collect()  # at most shingle x 64 rows
    widths = sorted({r["width"] for r in classes})
    bounds: dict[int, list[tuple[int, int]]] = {w: sorted((needed(1 << r["size_class"], threshold), r["top"] + (1 << 63)) for r in classes if r["width"] == w) for w in widths}
    packed_bits, size = filter_bits(sketch)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(k, T.LongType()) for k in KEY], T.StructField("text", T.StringType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("size", T.LongType())])))])
    kinds = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int64())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed_bits, np.uint8)).astype(bool)
        for batch in batches:
            kept, hits = [], []
            for k, text in enumerate(batch.column("text")):
                words, found = words_of(text.as_py()), []
                for w in widths:
                    own = shingle_hashes(words, [w])  # sorted
                    top = max((t for least, t in bounds[w] if least <= len(own)), default=-1)
                    if top >= 0:
                        low = own[: np.searchsorted(own, np.uint64(top), side="right")]
                        x, y = places_of(low, size)
                        found.extend({"hash": h, "size": len(own)} for h in low[known[x] & known[y]].view(np.int64).tolist())
                if found:
                    kept.append(k)
                    hits.append(found)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kinds)], names=schema.names)

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit("other"), "text").alias("other"), "text")
    found = stored(texts.mapInArrow(probe, schema))
    least = F.expr(f"greatest(ceil({threshold}D * shiftleft(1L, size_class) - 1e-9D), 1L)")
    each = found.select(*KEY, F.explode("hits").alias("hit")).select(*KEY, F.col("hit.hash").alias("hash"), F.col("hit.size").alias("size")).distinct()
    counts = each.groupBy("hash").agg(F.count("*").alias("n"))
    leads = sketch.groupBy("hash").agg(F.collect_set(F.struct(block.alias("block"), least.alias("least"))).alias("blocks"))  # at most blocks x 64
    met = hot_join(each, stored(leads.join(counts, "hash")), ["hash"], "n")
    reached = met.select(*KEY, "size", F.explode("blocks").alias("b")).where("size >= b.least").select(*KEY, "b.block").distinct()
    return found.select("doc_id", *KEY, "text"), stored(reached)


def block_of(items: DataFrame) -> Column:
    """The block of an item_id: as many blocks as the items' texts fill."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(chars // BLOCK_CHARS + 1))


VERDICT = T.StructType([*[T.StructField(k, T.LongType()) for k in KEY], *[T.StructField(n, T.LongType()) for n in ("n_items", "item_id", "n_shared", "n_shingles")]])


class Block:
    """The items of a block by their shingles. Shingles that the same items have share a list of them, and are counted together."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float):
        ids: dict[tuple[int, frozenset], set[int]] = {}
        for item_id, text in items:
            words = words_of(text)
            n = min(shingle, len(words))
            if n:
                ids.setdefault((n, frozenset(shingle_set(words, n))), set()).add(item_id)
        self.ids = [sorted(x) for x in ids.values()]
        self.one_class_each = sum(map(len, self.ids)) == len({i for x in self.ids for i in x})
        self.sizes = np.array([len(shingles) for _, shingles in ids], np.int64)
        self.needed = np.array([needed(len(shingles), threshold) for _, shingles in ids], np.int64)
        having: dict[tuple[int, tuple[str, ...]], list[int]] = {}
        for k, (n, shingles) in enumerate(ids):
            for s in shingles:
                having.setdefault((n, s), []).append(k)
        lists: dict[tuple[int, ...], int] = {}
        self.index: dict[int, dict[tuple[str, ...], int]] = {}
        for (n, s), of in having.items():
            self.index.setdefault(n, {})[s] = lists.setdefault(tuple(of), len(lists))
        self.lists = [np.array(of, np.int64) for of in lists]

    def contained(self, words: list[str]) -> tuple[int, int, int, int] | None:
        """How many items the words contain, and of the one of which most is contained its id, shared shingles and size."""
        counts: dict[int, int] = {}
        for n, index in self.index.items():
            seen = set()
            for i in range(len(words) - n + 1):
                s = tuple(words[i : i + n])
                found = index.get(s)
                if found is not None and s not in seen:  # each shingle counts once
                    seen.add(s)
                    counts[found] = counts.get(found, 0) + 1
        if not counts:
            return None
        shared = np.zeros(len(self.sizes), np.int64)
        for found, n in counts.items():
            shared[self.lists[found]] += n
        hits = np.flatnonzero(shared >= self.needed).tolist()
        if not hits:
            return None
        _, item, n_shared, size = min((-int(shared[k]) / int(self.sizes[k]), self.ids[k][0], int(shared[k]), int(self.sizes[k])) for k in hits)
        n_items = sum(len(self.ids[k]) for k in hits) if self.one_class_each else len({i for k in hits for i in self.ids[k]})
        return n_items, item, n_shared, size


def verdicts(found: DataFrame, reached: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """text_hash, other, n_items, item_id, n_shared and n_shingles of each text that contains items: how many, and the best.

    A text travels once for every block that it may contain an item of, and streams past the block's items. The texts of a block
    that many reach are dealt over all tasks, and the block's items repeated for each.
    """
    parts = shuffle_partitions(found.sparkSession)
    sizes = reached.groupBy("block").agg(F.count("*").alias("n"))
    share = (sizes.agg(F.sum("n")).first()[0] or 0) // parts + 1
    hot = [r[0] for r in sizes.where(F.col("n") > share).select("block").collect()]  # fewer than parts
    is_hot = F.col("block").isin(hot) if hot else F.lit(False)
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    dealt = F.explode(F.sequence(F.lit(0), F.when(is_hot, parts - 1).otherwise(0))).alias("salt")
    no = F.lit(None).cast("long")
    held = named.select("item_id", "text", block_of(items).alias("block")).select("block", dealt, "item_id", *[no.alias(k) for k in KEY], "text")
    texts = found.dropDuplicates(KEY).select(*KEY, "text").join(reached, KEY)
    asked = texts.select("block", F.when(is_hot, F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")).otherwise(0).alias("salt"), no.alias("item_id"), *KEY, "text")
    ordered = held.unionByName(asked).repartition(parts, "block", "salt").sortWithinPartitions("block", "salt", F.col("item_id").isNull())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, block = None, [], None
        for columns in rows_of(batches, ["block", "salt", "item_id", *KEY, "text"]):
            out: list[tuple] = []
            for at, salt, item_id, text_hash, other, text in zip(*columns, strict=True):
                if (at, salt) != now:
                    now, own, block = (at, salt), [], None
                if item_id is not None:
                    own.append((item_id, text))
                    continue
                if block is None:
                    block = Block(own, shingle, threshold)
                hit = block.contained(words_of(text))
                if hit is not None:
                    out.append((text_hash, other, *hit))
            made = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=VERDICT.names)

    each = ordered.mapInArrow(verify, VERDICT)
    best = F.min_by(F.struct("item_id", "n_shared", "n_shingles"), F.struct(-F.col("n_shared") / F.col("n_shingles"), "item_id")).alias("best")
    return each.groupBy(*KEY).agg(F.sum("n_items").alias("n_items"), best).select(*KEY, "n_items", "best.*")


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_items, item_id, n_shared, n_shingles and containment of each document that contains items: how many items,
    and the one of which most is contained (of equal ones the smallest item_id).

    Contained means that at least threshold of the item's distinct shingles (shingle words each; of an item with fewer
    words, all of them) occur in the text. Words are lower-cased runs of letters and digits. Null and empty texts
    contain nothing, items without words or an item_id are contained in nothing, repeated items (an item_id counts once)
    and repeated rows of a document once; rows without a doc_id are one row each text. Either table may be empty; other
    columns aren't read. Texts of any length are read whole.
    """
    found, reached = suspects(docs, items, shingle, threshold)
    named = found.select("doc_id", *KEY).distinct().join(stored(verdicts(found, reached, items, shingle, threshold)), KEY)
    return named.select("doc_id", "n_items", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item (see contaminated()).

    Rows with a null or empty text stay, repeated rows stay or go together; either table may be empty.
    """
    found, reached = suspects(docs, items, shingle, threshold)
    gone = stored(verdicts(found, reached, items, shingle, threshold).select(*KEY))  # a table, whose size tells whether it can be broadcast
    _, rows = packed(docs)
    return rows.withColumn("text_hash", F.xxhash64("row.text")).withColumn("other", F.xxhash64(F.lit("other"), "row.text")).join(gone, KEY, "left_anti").select("row.*")
