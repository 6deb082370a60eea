"""SimHash near-dedup (operator 4): fingerprints compared bit-sliced, links joined into groups.

Fingerprints that may be near share a key: for a small radius the bits of some of their blocks (those with at most r
differing bits agree on all but r blocks of any cut into blocks), for a large one two minimum hashes of their shingles.
Within a key's bucket the fingerprints' bits are stored as planes, 64 fingerprints a word, so that a few bitwise operations
with carry-save counters move 64 distances on by two bits; words of which all distances exceed the radius are left.
Of documents with few shingles the radius follows from their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import GOLDEN, cut, hot_join, mix, packed, shuffle_partitions, stored
from tsumugi.llm.components import connected_components

SEED = 42
#: Rows of a bucket that are compared in one piece (more are compared by pairs of pieces), and comparisons (a fingerprint with a word of 64) at a time.
MOST, STEP = 2048, 1 << 14
#: Pairs that are united at a time.
PAIRS = 1 << 17
#: Shingles whose bits are counted at a time.
COUNTED = 255 << 7


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles, in order and with repeats; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are 1 where over half of the hashes have a 1."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNTED):
        part = hashes[start : start + COUNTED].astype(">u8").view(np.uint8)
        bits = np.unpackbits(np.concatenate([part, np.zeros(-len(part) % (8 * 255), np.uint8)])).reshape(-1, 255, 64)
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 bits at most fit a byte
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def block_keys(fingerprint: int, radius: int) -> list[int]:
    """Keys of the permuted tables: of twice as many blocks as the radius, every choice of all but radius of them."""
    n = 2 * radius
    bounds = [64 * k // n for k in range(n + 1)]
    blocks = [(fingerprint >> a) & ((1 << (b - a)) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    out = []
    for k, chosen in enumerate(combinations(range(n), n - radius)):
        value = k
        for b in chosen:
            value = value << (bounds[b + 1] - bounds[b]) | blocks[b]
        out.append(signed(value if value < 1 << 62 else xxhash.xxh64_intdigest(str(value))))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Blocked:
    """64-bit fingerprints within a radius of at most 4, found by blocks: no link is lost."""

    def __init__(self, shingle: int = 3, radius: int = 2):
        self.shingle, self.radius, self.lanes = shingle, radius, 1
        self.radii = np.array([radius])

    def describe(self, text: str | None) -> tuple[bytes, list[int], int]:
        found = majority(shingle_hashes(text, self.shingle))
        return found.to_bytes(8, "big"), block_keys(found, self.radius), 0


#: Up to so many distinct shingles the share of differing bits is counted out; beyond, the angle gives it.
FEW = 128


def share_of_bits(a: int, b: int, c: int) -> float:
    """The chance that a bit differs between documents of a and b distinct shingles, c of them common: each shingle's bit is a coin."""
    tail = lambda n, above: sum(comb(n, k) for k in range(max(0, above + 1), n + 1)) / 2**n  # noqa: E731 (more than above ones)
    out = 0.0
    for x in range(c + 1):
        p, q = tail(a - c, a // 2 - x), tail(b - c, b // 2 - x)
        out += comb(c, x) / 2**c * (p * (1 - q) + q * (1 - p))
    return out


class Banded:
    """Wide fingerprints of distinct shingles, compared within buckets of two minimum hashes each.

    Documents of a shingle similarity (Jaccard) of s have an angle of acos(2s/(1+s)) at most, and the share of
    bits that differ is that angle over pi; of few shingles it is counted out (share_of_bits), for the pair of sizes with
    similarity s or more that has the largest share. The radius is that share and `slack` standard deviations, so a pair
    of similarity s is within it with a probability of 0.97; radii has it by the number of shingles of the smaller document,
    the last entry for all more. Of documents with similarity s, a bucket is shared with probability 1-(1-s^2)^bands: over
    0.999 for s=0.8 and 8 bands.
    """

    def __init__(self, shingle: int = 5, similarity: float = 0.8, lanes: int = 16, bands: int = 8, slack: float = 2.0):
        self.shingle, self.lanes, self.bands = shingle, lanes, bands
        shares = [0.0]
        for n in range(1, FEW):
            sizes = range(n, int(n / similarity + 1e-9) + 1)
            shares.append(max((share_of_bits(n, m, c) for m in sizes if (c := int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))) <= n), default=0.0))
        shares.append(float(np.arccos(2 * similarity / (1 + similarity)) / np.pi))
        share, bits = np.array(shares), 64 * lanes
        self.radii = (bits * share + slack * np.sqrt(bits * share * (1 - share))).astype(np.int64)

    def describe(self, text: str | None) -> tuple[bytes, list[int], int]:
        hashes = np.unique(shingle_hashes(text, self.shingle))
        if not len(hashes):
            return bytes(8 * self.lanes), [0], 0
        with np.errstate(over="ignore"):
            found = b"".join(majority(mix(hashes + np.uint64(k + 1) * GOLDEN)).to_bytes(8, "big") for k in range(self.lanes))
            least = [mix(hashes ^ (np.uint64(k + 101) * GOLDEN)).min() for k in range(2 * self.bands)]
            keys = [mix(np.array([least[2 * k] * GOLDEN + least[2 * k + 1] + np.uint64(k)]))[0] for k in range(self.bands)]
        return found, [signed(int(k)) for k in keys], min(len(hashes), FEW)


Method = Blocked | Banded


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(words, bits) of uint64: bit j of [w, i] is bit i of fingerprint 64 w + j."""
    n, lanes = prints.shape
    words = -(-n // 64)
    padded = np.zeros((words * 64, lanes), np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(words, 64, lanes * 8), axis=2)
    packed = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return packed.view("<u8")[:, :, 0].astype(np.uint64)


def near_lanes(prints: np.ndarray, planes: np.ndarray, rows: np.ndarray, words: np.ndarray, masks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each comparison (a row with the lanes of a word that its mask has), the lanes within the radius; as pairs of rows."""
    width = max(1, int(radius + 1).bit_length())
    start = (1 << width) - 1 - radius  # so that the counter's overflow tells that the radius is exceeded
    n_bits = prints.shape[1] * 64
    counters = [np.full(len(rows), (0xFFFFFFFFFFFFFFFF if start >> k & 1 else 0), np.uint64) for k in range(width)]
    over = np.zeros(len(rows), np.uint64)
    own = np.unpackbits(prints[rows].astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1).astype(bool)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(0, n_bits, 2):
        a = planes[words, i] ^ np.where(own[:, i], full, np.uint64(0))
        b = planes[words, i + 1] ^ np.where(own[:, i + 1], full, np.uint64(0))
        ones = counters[0]
        carry = (a & b) | (ones & (a ^ b))
        counters[0] = ones ^ a ^ b
        for k in range(1, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if i % 16 == 14:  # leave comparisons without a lane that is still near
            alive = (masks & ~over) != 0
            if not alive.all():
                rows, words, masks, over, own = rows[alive], words[alive], masks[alive], over[alive], own[alive]
                counters = [c[alive] for c in counters]
                if not len(rows):
                    return np.empty(0, np.int64), np.empty(0, np.int64)
    near = masks & ~over
    at, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little"))
    return rows[at], words[at] * 64 + lane


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each at most its index), after the links a-b."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        least = np.minimum(x, y)
        np.minimum.at(labels, x, least)
        np.minimum.at(labels, y, least)
        while (labels != (up := labels[labels])).any():
            labels = up


def bucket_roots(prints: np.ndarray, bucket: np.ndarray, sizes: np.ndarray, radii: np.ndarray, since: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by bucket: the first row of each row's group, where rows of a bucket within the radius are linked.

    The radius of two rows is that in radii for the smaller of their sizes. A row is compared with those of its bucket from
    row since on (those after it, if that isn't given).
    """
    n, own_size = len(prints), np.minimum(sizes, len(radii) - 1)
    present = radii[np.unique(own_size)]
    radius = int(present.max(initial=0))
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[first, n])
    end = np.repeat(first + sizes, sizes)
    own = np.arange(n)
    since = own + 1 if since is None else since
    keep = since < end
    rows = own[keep]
    from_word, to_word = since[keep] // 64, (end[keep] - 1) // 64
    count = to_word - from_word + 1
    labels, planes = own.copy(), planes_of(prints)
    task = np.repeat(np.arange(len(rows)), count)
    word = np.arange(len(task)) - np.repeat(np.cumsum(count) - count, count) + from_word[task]
    for start in range(0, len(task), STEP):
        t, w = task[start : start + STEP], word[start : start + STEP]
        low = np.clip(since[rows[t]] - 64 * w, 0, 64)
        high = np.clip(end[rows[t]] - 64 * w, 0, 64)
        upto = lambda k: np.where(k >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        a, b = near_lanes(prints, planes, rows[t], w, upto(high) & ~upto(low), radius)
        for k in range(0, len(a), PAIRS):
            x, y = a[k : k + PAIRS], b[k : k + PAIRS]
            if (present != radius).any():  # some pairs have a smaller radius
                near = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1) <= radii[np.minimum(own_size[x], own_size[y])]
                x, y = x[near], y[near]
            labels = unite(labels, x, y)
    return labels


LINK = T.StructType([*[T.StructField(c, T.LongType()) for c in ("a", "b", "key", "size")], T.StructField("print", T.BinaryType())])
LINK_ARROW = pa.schema([*[(c, pa.int64()) for c in ("a", "b", "key", "size")], ("print", pa.binary())])


def links_in_buckets(rows: DataFrame, lanes: int, radii: np.ndarray) -> DataFrame:
    """rows (key, node, size, print) sorted by key -> links a-b that join what is near in each bucket, without the pairs.

    The rows of a bucket of over MOST come back as they are (b is null), for near_by_neighbours() or near_by_pieces(),
    which find just the same links: MOST changes where buckets are compared, not what is linked.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (*[np.empty(0, np.int64)] * 3, np.empty((0, lanes), np.uint64))  # key, node, size and print, of the last bucket so far
        passing: int | None = None  # the key of a bucket that comes back
        for batch in with_end(batches):
            out: list[tuple] = []  # a, b, key, size, print

            def back(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> None:
                out.extend((a, None, k, n, p.astype(">u8").tobytes()) for a, k, n, p in zip(nodes.tolist(), keys.tolist(), sizes.tolist(), prints, strict=True))

            def link(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> None:
                """Links whole buckets."""
                roots = bucket_roots(prints, keys, sizes, radii)
                hit = np.flatnonzero(roots != np.arange(len(keys)))
                out.extend((a, b, None, None, None) for a, b in zip(nodes[hit].tolist(), nodes[roots[hit]].tolist(), strict=True))

            if batch is not None:
                data = b"".join(batch.column("print").to_pylist())
                new = (*[batch.column(c).to_numpy() for c in ("key", "node", "size")], np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, lanes))
                if passing is not None:
                    n = int(np.searchsorted(new[0] != passing, True))
                    back(*(x[:n] for x in new))
                    new = tuple(x[n:] for x in new)
                    passing = passing if not len(new[0]) else None
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            if len(held[0]):
                first = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
                whole = first[-1] if batch is not None else len(held[0])
                counts = np.diff(np.r_[first, len(held[0])])
                much = np.repeat(counts > MOST, counts)
                small = np.flatnonzero(~much[:whole])
                if len(small):
                    link(*(x[small] for x in held))
                for start, count in zip(first.tolist(), counts.tolist(), strict=True):
                    if count > MOST and start < whole:
                        back(*(x[start : start + count] for x in held))
                held = tuple(x[whole:] for x in held)
                if len(held[0]) > MOST:  # the last bucket, which may go on
                    back(*held)
                    passing, held = int(held[0][0]), tuple(x[:0] for x in held)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, LINK_ARROW.types, strict=True)], schema=LINK_ARROW)

    return rows.mapInArrow(kernel, LINK)


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_by_neighbours(rows: DataFrame) -> DataFrame:
    """Links a-b among rows (a, print) that differ in at most two bits, for 64-bit prints: time linear in the rows.

    Two of them are that near just when they share a neighbour, a number that differs from each in at most one bit; and no
    number has more than 65 neighbours, however many rows there are.
    """
    bits = rows.select("a", "print").distinct().select("a", "print", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    high, low = (F.conv(F.substring(F.hex("print"), at, 8), 16, 10).cast("long") for at in (1, 9))
    flip = lambda part, base: F.when(F.col("bit").between(base, base + 31), part.bitwiseXOR(F.expr(f"shiftleft(1L, bit - {base})"))).otherwise(part)
    near = bits.select("a", flip(high, 32).alias("high"), flip(low, 0).alias("low"))
    groups = near.groupBy("high", "low").agg(F.collect_set("a").alias("members")).where(F.size("members") > 1)
    return groups.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a != b").select("a", "b").distinct()


def near_by_pieces(rows: DataFrame, lanes: int, radii: np.ndarray) -> DataFrame:
    """Links a-b that join what is near among the rows (a, key, size, print) of each key: every pair of its rows is compared.

    A key's rows are dealt into pieces of about MOST by a hash of a, and each two pieces (and each with itself) to a group
    of their own, so that no task has more than two pieces at a time. A row goes to as many groups as its key has pieces,
    and the comparisons grow with the square of a key's rows, as they must where all of them are to be found.
    """
    n = shuffle_partitions(rows.sparkSession)
    pieces = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.count("*") / MOST).cast("int").alias("pieces")))
    dealt = hot_join(rows.select("a", "key", "size", "print"), pieces, ["key"], "n").withColumn("own", F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    paired = each.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "a", "size", "print")
    ordered = paired.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "second", "a")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty((0, 3), np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, lanes), np.uint64))  # of the last group so far
        for batch in with_end(batches):
            if batch is not None:
                group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
                data = b"".join(batch.column("print").to_pylist())
                new = (group, batch.column("second").to_numpy(zero_copy_only=False), batch.column("a").to_numpy(), batch.column("size").to_numpy(), np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, lanes))
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(held[0]):
                continue
            first = np.flatnonzero(np.r_[True, (held[0][1:] != held[0][:-1]).any(axis=1)])
            whole = int(first[-1]) if batch is not None else len(held[0])
            if not whole:
                continue
            group, second, nodes, sizes, prints = (x[:whole] for x in held)
            held = tuple(x[whole:] for x in held)
            first = first[first < whole]
            counts = np.diff(np.r_[first, whole])
            end = np.repeat(first + counts, counts)
            other = np.repeat(first + counts - np.add.reduceat(second.astype(np.int64), first), counts)  # where the second piece begins
            since = np.where(group[:, 1] == group[:, 2], np.arange(whole) + 1, np.where(second, end, other))
            roots = bucket_roots(prints, np.repeat(np.arange(len(first)), counts), sizes, radii, since)
            hit = np.flatnonzero(roots != np.arange(whole))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit], pa.int64()), pa.array(nodes[roots[hit]], pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(kernel, "a long, b long").distinct()


def describe(docs: DataFrame, method: Method, text: str = "text") -> DataFrame:
    """doc_id, text_hash, print, keys and size (see Banded) of each row of docs, kept in the shared folder."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("_text"))
    schema = T.StructType([*one.schema.fields[:2], T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])
    names = [f.name for f in schema.fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [method.describe(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.int64())], names=names)

    return cut(one.mapInArrow(kernel, schema))


def near_groups(docs: DataFrame, method: Method, text: str = "text") -> DataFrame:
    """doc_id, text_hash, print and component_id (the smallest doc_id reachable by links) of each row of docs.

    Equal fingerprints are one class, whose smallest doc_id stands for it; only classes are compared. Null and empty texts
    have the fingerprint 0 and are linked like any other. Rows of one doc_id are one document. Rows without a doc_id take
    the component of equal fingerprints that have one; a class without any has none (null). An empty table gives no rows.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = describe(docs, method, text)
    classes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("keys", "size"), "text_hash").alias("own")))
    keyed = classes.where("node is not null").select(F.explode("own.keys").alias("key"), "node", "own.size", "print")
    found = cut(links_in_buckets(keyed.repartition(n, "key").sortWithinPartitions("key", "node"), method.lanes, method.radii))
    large = found.where("b is null")
    more = near_by_neighbours(large) if isinstance(method, Blocked) and method.radius == 2 else near_by_pieces(large, method.lanes, method.radii)
    links = found.where("b is not null").select("a", "b").unionByName(more)
    roots = connected_components(links)
    named = classes.select("print", "node").join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    return rows.select("doc_id", "text_hash", "print").join(named, "print")


def keep_one_each(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs of which each group keeps one: its smallest doc_id (of equal ids and of rows without any, the least text)."""
    own = F.when(F.col("doc_id").isNull(), F.col("print"))
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = stays.groupBy("doc_id", own).agg(F.min("text_hash").alias("keep"), F.count("*").alias("n")).select(F.col("doc_id").alias("id"), "keep", "n")
    _, marked = packed(docs)
    marked = marked.select("row", F.col("row.doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(f"row.{text}"), F.lit(""))).alias("hash"))
    kept = marked.join(ids, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("keep")))
    first = Window.partitionBy("id", "hash").orderBy(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
    more = kept.where("n > 1").withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.where("n = 1").select("row.*").unionByName(more.select("row.*"))
