"""Substring dedup (operator 9): prefix-partitioned suffix trees over the windows that may repeat.

Equal windows pick equal anchors: the least hash among a window's sequences of as many words as the prefix has. So suffixes
are split by the prefix at their window's anchor: neighbouring windows mostly share it, and their words travel once. A
group of one document has no repeat and ends there. Prefixes have variable lengths (LENGTHS): a group that is too large for
memory is split by longer ones, whose anchors are sought among its windows only. A group of a size that fits is one subtree:
its suffixes are sorted with the lengths of their common prefixes (a suffix array, made for many groups at a time), and
internal nodes that are as deep as a window are the repeats. At the last length a group's suffixes have all their words
in common, so that it is one node, and its smallest doc_id an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import GOLDEN, ascii_words, hot_join, mix, rolling, rows_of, shuffle_partitions, stored, word_hashes

WINDOW = 50
#: Lengths of the prefixes in words, below the window: groups that are too large are split by the next, at last by the whole window.
LENGTHS = (10, 30)
#: The end of a span that takes all words of a text, if it has a window's length.
WHOLE = -1
#: Suffix runs of a group, at most, for a subtree of its own (same repeats for any number).
MOST = 2000
#: Words of the groups that are sorted together (a group isn't split), and windows whose anchors are sought at a time.
TOGETHER, PIECE = 1 << 17, 1 << 14


def anchors_of(words: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window, and the hash of the prefix at each place."""
    grams = mix(rolling(word_hashes(words), prefix)) if len(words) >= window else np.empty(0, np.uint64)
    span, n = window - prefix + 1, len(words) - window + 1
    places = np.empty(max(0, n), np.int64)
    for start in range(0, n, PIECE):
        part = grams[start : min(start + PIECE, n) + span - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, span)
        places[start : start + len(view)] = view.argmin(axis=1) + np.arange(start, start + len(view))
    return places, grams


def runs_of(places: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of open windows with one anchor."""
    at = np.flatnonzero(open_)
    if not len(at):
        return at, at
    first = np.flatnonzero(np.r_[True, (places[at][1:] != places[at][:-1]) | (at[1:] != at[:-1] + 1)])
    return at[first], at[np.r_[first[1:], len(at)] - 1]


def open_windows(words: list[bytes], window: int, lengths: tuple[int, ...], large: list[list[int]]) -> np.ndarray:
    """Which windows are in a large group at each of the lengths."""
    out = np.ones(max(0, len(words) - window + 1), bool)
    for length, keys in zip(lengths, large, strict=True):
        places, grams = anchors_of(words, window, length)
        out &= np.isin(grams[places].view(np.int64), np.array(keys, np.int64))
    return out


def suffix_array(texts: list[list[bytes]], group: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of window words or more, of texts that are grouped: as text and place, sorted by group and words, and
    how many words each has in common with the one before (none across groups). By prefix doubling.
    """
    ids: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    own = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes + 1) - sizes - 1  # a text is followed by an end of its own, which equals nothing
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    n = len(text)
    inside = np.ones(n, bool)
    inside[begin + sizes] = False
    rank = np.empty(n, np.int64)
    words = np.unique(np.repeat(np.array(group, np.int64), sizes) * len(ids) + own, return_inverse=True)[1]
    rank[inside] = words
    rank[~inside] = words.max(initial=-1) + 1 + np.arange(len(texts))
    ranks, width = [rank], 1  # by the first 1, 2, 4 ... words
    while width < sizes.max(initial=0) + 1:
        after = np.zeros(n, np.int64)
        after[:-width] = ranks[-1][width:]
        unique, rank = np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)
        ranks.append(rank)
        width *= 2
        if len(unique) == n:
            break
    place = np.arange(n) - begin[text]
    chosen = np.flatnonzero(inside & (place + window <= sizes[text]))
    chosen = chosen[np.argsort(ranks[-1][chosen], kind="stable")]
    a, b = chosen[:-1].copy(), chosen[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # an end lies between, so that no step leaves the texts
        same = ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]
        step = same * (1 << k)
        common, a, b = common + step, a + step, b + step
    return text[chosen], place[chosen], np.r_[0, common][: len(chosen)]


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix, the number of its uppermost node of at least that depth (a leaf is a node of its own)."""
    return np.cumsum(common < depth) - 1


def repeats_in(groups: list[list[tuple]], window: int) -> list[tuple]:
    """Each group's rows (doc_id, text_hash, places, segment) share a prefix -> (doc_id, text_hash, places, start, end) to remove.

    A document has a row for each different segment, with the places at which it begins; start and end count from there. A
    segment counts once in its group's subtree, with the smallest doc_id of its rows. A window goes where the node at its
    full depth has a leaf of a smaller doc_id.
    """
    out: list[tuple] = []
    texts: list[list[bytes]] = []
    owner: list[int] = []
    members: list[list[tuple]] = []
    for g, rows in enumerate(groups):
        by_segment: dict[bytes, list[tuple]] = {}
        for doc_id, text_hash, places, segment in rows:
            by_segment.setdefault(segment, []).append((doc_id, text_hash, places))
        if len(by_segment) == 1:  # a tree of one path
            ((segment, own),) = by_segment.items()
            least, n = min(m[0] for m in own), segment.count(b" ") + 1
            out.extend((d, t, places, 0, n) for d, t, places in own if d > least)
            continue
        for segment, own in by_segment.items():
            texts.append(segment.split(b" "))
            owner.append(g)
            members.append(own)
    if not texts:
        return out
    text, place, common = suffix_array(texts, owner, window)
    least_of = np.array([min(m[0] for m in own) for own in members], np.int64)
    node = deep_nodes(common, window)
    least = np.minimum.reduceat(least_of[text], np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))[node]  # of each suffix's node
    order = np.lexsort((place, text))
    bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
    least = least[order]
    for k, own in enumerate(members):
        mine = least[bounds[k] : bounds[k + 1]]  # by place
        for doc_id, text_hash, places in own:
            gone = np.flatnonzero(mine < doc_id)
            if len(gone):
                cuts = np.flatnonzero(np.diff(gone) > 1) + 1
                out.extend((doc_id, text_hash, places, int(g[0]), int(g[-1]) + window) for g in np.split(gone, cuts))
    return out


IDS = [T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType())]
PLACES = T.StructField("places", T.ArrayType(T.LongType()))
SPAN = T.StructType([*IDS, PLACES, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.list_(pa.int64())), ("start", pa.int64()), ("end", pa.int64())])
MARKS = T.StructType([*IDS, T.StructField("other", T.LongType()), T.StructField("keys", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("runs", T.LongType())])))])


def anchor_keys(docs: DataFrame, window: int, lengths: tuple[int, ...], level: int) -> DataFrame:
    """docs: doc_id, text_hash, other, text, and large (the keys of large groups by level) unless this is the first level ->
    each text's anchors at this level of the windows that are open, with the number of their runs; texts without any are left.
    """
    columns = ["doc_id", "text_hash", "other", "text", *(["large"] if level else [])]
    kinds = pa.list_(pa.struct([("key", pa.int64()), ("runs", pa.int64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, others, texts, *large in rows_of(iter([batch]), columns):
                kept, keys, runs, ends = [], [], [], [0]
                for k, text in enumerate(texts):
                    words = ascii_words(text)
                    if len(words) >= window:
                        open_ = open_windows(words, window, lengths[:level], large[0][k] if level else [])
                        places, grams = anchors_of(words, window, lengths[level])
                        first, _ = runs_of(places, open_)
                        own, n = np.unique(grams[places[first]].view(np.int64), return_counts=True)
                        if len(own):
                            kept.append(k)
                            keys.append(own)
                            runs.append(n)
                            ends.append(ends[-1] + len(own))
                if kept:
                    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(runs), pa.int64())], names=["key", "runs"])
                    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(kinds)
                    yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for k in kept], pa.int64()) for x in (ids, hashes, others)], own], names=MARKS.names)

    return docs.select(*columns).mapInArrow(kernel, MARKS)


def grouped_keys(marks: DataFrame) -> DataFrame:
    """marks: doc_id, text_hash, keys -> each text's keys that another doc_id has too: of groups that fit (small) and not (large)."""
    each = marks.select("doc_id", "text_hash", F.explode("keys").alias("x")).select("doc_id", "text_hash", "x.key", "x.runs")
    shared = stored(each.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"), (F.sum("runs") > MOST).alias("large")).where("a < b").select("key", "n", "large"))
    known = hot_join(each.drop("runs"), shared, ["key"], "n")
    of = lambda large: F.collect_set(F.when(F.col("large") == large, F.col("key")))
    return stored(known.groupBy("doc_id", "text_hash").agg(of(False).alias("small"), of(True).alias("large")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """docs: doc_id, text_hash, other, text -> spans of words to remove: from start to end after each of the places.

    All windows of a text that a smaller doc_id has too are repeats: such copies go whole (end is WHOLE) and their anchors
    aren't followed up; the text's first document stands for them. text_hash and other are 128 bits of the text.
    """
    n, levels = shuffle_partitions(docs.sparkSession), len(lengths)
    known = docs.where("doc_id is not null")
    marks = stored(anchor_keys(known, window, lengths, 0))
    first = stored(marks.groupBy("text_hash", "other").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("text_hash", "other", "least", "n"))
    copies = stored(hot_join(marks.select("doc_id", "text_hash", "other"), first, ["text_hash", "other"], "n").where("doc_id > least").select("doc_id", "text_hash").distinct())
    no_keys = F.array().cast("array<array<bigint>>")

    def with_keys(lists: DataFrame) -> DataFrame:
        return known.join(lists, ["doc_id", "text_hash"])

    per_level: list[DataFrame] = []  # what each level has in small groups, beside the large ones of the levels before
    large_at: DataFrame | None = None  # the keys of large groups at all levels so far
    for level in range(levels):
        own = grouped_keys(anchor_keys(with_keys(large_at), window, lengths, level) if level else marks.join(copies, ["doc_id", "text_hash"], "left_anti"))
        before = own.join(large_at.withColumnRenamed("large", "before"), ["doc_id", "text_hash"]) if level else own.withColumn("before", no_keys)
        chosen = before.where("size(small) > 0").select("doc_id", "text_hash", "small", F.col("before").alias("large"))
        per_level.append(stored(chosen) if level else chosen)
        large_at = stored(before.where("size(large) > 0").select("doc_id", "text_hash", F.concat("before", F.array("large")).alias("large")))

    def segments(level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, texts, smalls, larges in rows_of(iter([batch]), ["doc_id", "text_hash", "text", "small", "large"], most=128):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text_hash, text, small, large in zip(ids, hashes, texts, smalls, larges, strict=True):
                    words = ascii_words(text)
                    places, grams = anchors_of(words, window, lengths[level])
                    open_ = open_windows(words, window, lengths[:level], large) & np.isin(grams[places].view(np.int64), np.array(small, np.int64))
                    starts, ends = runs_of(places, open_)
                    own = (mix(grams[places[starts]] + np.uint64(level)) if level else grams[places[starts]]).view(np.int64)
                    found: dict[tuple[int, bytes], list[int]] = {}  # a text that repeats itself has few different segments
                    for key, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True):
                        found.setdefault((key, b" ".join(words[a : b + window])), []).append(a)
                    for (key, segment), at in found.items():
                        for x, y in zip(out, (key, doc_id, text_hash, at, segment), strict=True):
                            x.append(y)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["key", "doc_id", "text_hash", "places", "segment"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, texts, larges in rows_of(iter([batch]), ["doc_id", "text_hash", "text", "large"], most=128):
                for doc_id, text_hash, text, large in zip(ids, hashes, texts, larges, strict=True):
                    words = ascii_words(text)
                    at = np.flatnonzero(open_windows(words, window, lengths, large))
                    h1, h2 = (mix(rolling(mix(word_hashes(words) + np.uint64(k) * GOLDEN), window))[at].view(np.int64) for k in range(2))
                    order = np.lexsort((at, h2, h1))
                    h1, h2, at = h1[order], h2[order], at[order]
                    begin = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(at)])
                    own = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(at)].astype(np.int32)), pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(h1[begin]), pa.array(h2[begin]), pa.array(np.full(len(begin), doc_id)), pa.array(np.full(len(begin), text_hash)), own], names=["h1", "h2", "doc_id", "text_hash", "places"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []  # groups, of which the last may go on
        key, size = None, 0
        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    if size > TOGETHER * 6:  # bytes, of words of about six
                        yield spans(repeats_in([g for g in held if len(g) > 1], window))
                        held, size = [], 0
                    held.append([])
                    key = k
                held[-1].append(tuple(row))
                size += len(row[3])
        yield spans(repeats_in([g for g in held if len(g) > 1], window))

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SPAN_ARROW.types, strict=True)], schema=SPAN_ARROW)

    segment = T.StructType([T.StructField("key", T.LongType()), *IDS, PLACES, T.StructField("segment", T.BinaryType())])
    of_level = [with_keys(lists).select("doc_id", "text_hash", "text", "small", "large").mapInArrow(partial(segments, level), segment) for level, lists in enumerate(per_level)]
    parts = reduce(DataFrame.unionByName, of_level)
    small = parts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trees, SPAN)
    each = with_keys(large_at).select("doc_id", "text_hash", "text", "large").mapInArrow(windows, T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), *IDS, PLACES]))
    least = stored(each.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("h1", "h2", "least", "n"))
    number = lambda k: F.lit(k).cast("long")
    large = hot_join(each, least, ["h1", "h2"], "n").where("doc_id > least").select("doc_id", "text_hash", "places", number(0).alias("start"), number(window).alias("end"))
    whole = copies.select("doc_id", "text_hash", F.array(number(0)).alias("places"), number(0).alias("start"), number(WHOLE).alias("end"))
    return small.unionByName(large).unionByName(whole)


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in a span."""
    change = np.zeros(n + 1, np.int64)
    for s in spans:
        if s["end"] == WHOLE:
            return np.full(n, n >= window)
        at = np.array(s["places"], np.int64)
        np.add.at(change, at + s["start"], 1)
        np.add.at(change, at + s["end"], -1)
    return np.cumsum(change[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS, layout: bool = False) -> DataFrame:
    """The rows of docs with what repeats removed from text, and n_words and n_removed.

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window (that many consecutive words) covers it whose words also
    begin somewhere in a document of a smaller doc_id; all windows are judged on the texts as they came. Kept words are joined by one
    space or, with layout, keep the white space after them, and texts of which nothing goes stay as they are.
    A null text stays null, with 0 words. A row without a doc_id neither loses words nor makes others lose them. Rows of
    one doc_id don't affect each other. Texts of fewer words than a window stay whole. Other columns pass through, but for
    ones named n_words or n_removed, which give way.
    """
    keep = docs.drop("n_words", "n_removed")
    others = [c for c in keep.columns if c != "text"]
    hashed = keep.select(F.struct(*[keep[c] for c in others]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    dealt = hashed.select("doc_id", "text_hash", F.xxhash64(F.lit("other"), "text").alias("other"), "text")
    gone = repeated_spans(dealt, window, lengths).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("places", "start", "end")).alias("spans"))
    left = hashed.join(gone, ["doc_id", "text_hash"], "left").select("row", "text", "spans")
    schema = T.StructType([*left.schema.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def kept(text: str, words: list[bytes], gone: np.ndarray) -> str:
        if not layout:
            return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        word = np.cumsum(np.diff(np.r_[False, inside].astype(np.int8)) == 1)  # the number of the word that began last
        stays = np.r_[True, ~gone][word]
        return raw[stays].tobytes().decode("utf-8", "surrogatepass")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, n_words, n_removed = [], [], []
            for texts, spans in rows_of(iter([batch]), ["text", "spans"]):
                for text, own in zip(texts, spans, strict=True):
                    words = ascii_words(text)
                    out = covered(len(words), own, window) if own else np.zeros(len(words), bool)
                    n_words.append(len(words))
                    n_removed.append(int(out.sum()))
                    new.append(text if text is None or layout and not out.any() else kept(text, words, out))
            made = [pa.array(new, batch.schema.field(1).type), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    found = left.mapInArrow(kernel, schema)
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep.columns], "n_words", "n_removed")
