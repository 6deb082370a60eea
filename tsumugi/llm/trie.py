"""Conversation prefix trie (operator 11): what conversations share from their first turn on.

A conversation is the sequence of its turns' 128-bit hashes, written one behind the other as one binary key. Distinct keys
are dealt to tasks by range, so that conversations with a common beginning are neighbours. A task takes the longest common
prefixes of neighbours as edges and unites them in descending depth (union-find): each union of two components creates a
branching node, or adds to the one that stands there, and the turns between it and the tops of both components are its
chains below. A node on the way to a task's first or last key may go on in other tasks: it stays open. Open nodes are what
the forests of the tasks are contracted to, at most two ways down a task; they are merged by the hash of their prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import hot_join, shuffle_partitions, stored

#: Bytes of a turn's hash, ids in one piece of a list of ids, and the hash of an empty list.
WIDTH, PIECE, NO_ENDS = 16, 512, hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODE_SCHEMA = "open boolean, id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_words long, ends binary"
NODE = pa.schema([("open", pa.bool_()), ("id", pa.binary()), ("parent_id", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_words")], ("ends", pa.binary())])


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (hash, n_words), of each conversation: its rows by turn (null first), equal turns by their hash.

    Null roles and texts count as empty. Rows without a conv_id belong to no conversation. Texts are hashed where they are
    read; a turn travels as 32 hexadecimal digits and a number.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").alias("turn"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    listed = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["hash"].alias("hash"), t["n_words"].alias("n_words"))).alias("turns"))


def with_shared_heads(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c rebuilt: the first h turns of conversation c - c % every (none if absent), then its own after its first h; h = crc32(c) % most. % has the sign of c, as in SQL."""
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = seqs.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).join(heads, "head", "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def keyed(seqs: DataFrame) -> DataFrame:
    """conv_id, the key, its hash and the words of each turn."""
    return seqs.select("conv_id", F.unhex(F.array_join("turns.hash", "")).alias("key"), F.col("turns.n_words").alias("n_words")).select(F.unhex(F.md5("key")).alias("id"), "conv_id", "key", "n_words")


def end_lists(ids: DataFrame) -> DataFrame:
    """n, the smallest conv_id and the SHA-256 of all conv_ids in order, for each id of (id, conv_id).

    Ids of one key are dealt by range of (id, conv_id), so those of a common key are written out by many tasks, in pieces;
    one task then hashes the pieces as they stream past.
    """
    n = shuffle_partitions(ids.sparkSession)
    pieces = pa.schema([("id", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("listed", pa.binary())])
    digests = pa.schema([("id", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.binary())])

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, group in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                of_key = [c for _, c in group]
                out += [{"id": key, "conv_id": some[0], "n": len(some), "listed": ",".join(map(str, some)).encode()} for some in (of_key[k : k + PIECE] for k in range(0, len(of_key), PIECE))]
            yield pa.RecordBatch.from_pylist(out, schema=pieces)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, smallest, count, sha = None, 0, 0, hashlib.sha256()
        ended = lambda: {"id": now, "conv_id": smallest, "n": count, "ends": sha.digest()}
        for batch in batches:
            out = []
            for key, first, k, listed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == now:
                    sha.update(b"," + listed)
                    count += k
                    continue
                if now is not None:
                    out.append(ended())
                now, smallest, count, sha = key, first, k, hashlib.sha256(listed)
            yield pa.RecordBatch.from_pylist(out, schema=digests)
        if now is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=digests)

    written = ids.select("id", "conv_id").repartitionByRange(n, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(write_out, "id binary, conv_id long, n long, listed binary")
    return written.repartition(n, "id").sortWithinPartitions("id", "conv_id").mapInArrow(digest, "id binary, conv_id long, n long, ends binary")


def common_turns(a: bytes, b: bytes) -> int:
    """How many whole turns two keys share from the start (by halving: slices are compared at once)."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def path_ids(key: bytes) -> list[bytes]:
    """The hash of each prefix of a key, from the root on."""
    md5, out = hashlib.md5(), [hashlib.md5().digest()]
    for k in range(0, len(key), WIDTH):
        md5.update(key[k : k + WIDTH])
        out.append(md5.copy().digest())
    return out


class Forest:
    """The trie over one task's keys, by unions of neighbours in descending depth.

    A component is a run of neighbouring keys and stands at its root in the union-find, with the depth of its topmost node,
    its conversations, and the children, leaves and saved tokens of those subtrees that can't go on in another task.
    """

    def __init__(self, convs: list[int], counts: list[int], ends: list[bytes], words: list[np.ndarray], edges: list[int], first: list[bytes], last: list[bytes]):
        n = len(convs)
        self.parent, self.size = list(range(n)), n
        self.top, self.conv, self.convs = [len(w) for w in words], convs, counts
        self.ends: list[bytes | None] = list(ends)
        self.low, self.high = list(range(n)), list(range(n))
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        self.node, self.alias = list(range(n)), list(range(n))
        self.words, self.edges, self.paths = words, edges, (first, last)
        self.node_conv: dict[int, int] = {}
        self.node_id: dict[int, bytes] = {}
        self.rows: dict[str, list] = {f: [] for f in NODE.names}
        self.above: list[int | None] = []

    def find(self, i: int, of: list[int]) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def path(self, x: int) -> list[bytes] | None:
        """The prefixes' hashes along the task's first or last key, if x holds it: x's nodes may then go on in another task."""
        return self.paths[0] if self.low[x] == 0 else self.paths[1] if self.high[x] == self.size - 1 else None

    def put(self, x: int, depth: int, path: list[bytes] | None, children: int, leaves: int, saved: int, ends: bytes | None, above: int | None) -> None:
        values = (path is not None, path and path[depth], path[depth - 1] if path and depth else None, depth, self.conv[x], None if depth == 0 else self.conv[x], self.convs[x], children, leaves, saved, int(self.words[x][depth - 1]) if depth else 0, ends)
        for column, value in zip(self.rows.values(), values, strict=True):
            column.append(value)
        self.above.append(above)

    def close(self, x: int, depth: int, above: int | None) -> tuple[int, int] | None:
        """Writes x's topmost node and its chain, down from just below that depth; its leaves and saved tokens unless it is open."""
        path, top, words = self.path(x), self.top[x], self.words[x]
        number = self.find(self.node[x], self.alias)
        self.node_conv[number] = self.conv[x]
        if path is not None:
            self.node_id[number] = path[top]
            for d in range(top, depth, -1):
                own = d == top
                self.put(x, d, path, self.children[x] if own else 0, self.leaves[x] if own else 0, self.saved[x] if own else 0, self.ends[x] if own else None, None)
            return None
        leaves, saved = max(1, self.leaves[x]), self.saved[x]
        for d in range(top, depth, -1):
            saved += (self.convs[x] - 1) * int(words[d - 1])
            self.put(x, d, None, self.children[x] if d == top else 1, leaves, saved, self.ends[x] if d == top else None, above if d == depth + 1 else None)
        return leaves, saved

    def unite(self, i: int, depth: int) -> None:
        a, b = self.find(i, self.parent), self.find(i + 1, self.parent)
        tops = [x for x in (a, b) if self.top[x] == depth]
        if tops:
            number = self.find(self.node[tops[0]], self.alias)
            if len(tops) == 2:
                self.alias[self.find(self.node[b], self.alias)] = number
        else:
            number = len(self.alias)
            self.alias.append(number)
        totals = [sum(self.children[x] for x in tops), sum(self.leaves[x] for x in tops), sum(self.saved[x] for x in tops)]
        for x in (a, b):
            if x not in tops:
                closed = self.close(x, depth, number)
                if closed is not None:
                    totals = [totals[0] + 1, totals[1] + closed[0], totals[2] + closed[1]]
        ends = next((self.ends[x] for x in tops if self.ends[x] is not None), None)
        self.parent[b] = a
        self.high[a] = self.high[b]
        self.convs[a] += self.convs[b]
        self.conv[a] = min(self.conv[a], self.conv[b])
        self.top[a], self.node[a], self.ends[a] = depth, number, ends
        self.children[a], self.leaves[a], self.saved[a] = totals

    def grow(self) -> pa.RecordBatch:
        for i in np.argsort(-np.asarray(self.edges, np.int64), kind="stable").tolist():
            self.unite(i, self.edges[i])
        self.close(self.find(0, self.parent), -1, None)
        for k, above in enumerate(self.above):
            if above is not None:
                above = self.find(above, self.alias)
                if above in self.node_id:
                    self.rows["parent_id"][k], self.rows["parent_conv_id"][k] = self.node_id[above], None
                else:
                    self.rows["parent_conv_id"][k] = self.node_conv[above]
        return pa.RecordBatch.from_pydict(self.rows, schema=NODE)


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one task's keys, which come in order; a key is held until its neighbour has been seen, and the first until the end."""
    convs, counts, ends, words, edges = [], [], [], [], []
    first = before = None
    for batch in batches:
        for key, w, conv, n, e in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if before is None:
                first = key
            else:
                edges.append(common_turns(before, key))
            before = key
            convs.append(conv), counts.append(n), ends.append(e), words.append(np.array(w, np.int64))
    if first is not None:
        yield Forest(convs, counts, ends, words, edges, path_ids(first), path_ids(before)).grow()


def sums_upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole children, leaves and saved tokens of merged open nodes, which come deepest first: only the sums for the depth above are held."""
    pending: dict[bytes, list[int]] = {}
    upper: dict[bytes, list[int]] = {}
    depth = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["depth"] != depth:
                depth, pending, upper = row["depth"], upper, {}
            children, leaves, saved = pending.pop(row["id"], (0, 0, 0))
            row["n_closed"] = row["n_children"]
            row["n_children"] += children
            row["n_leaves"] = max(1, row["n_leaves"] + leaves)
            row["saved_tokens"] += saved + (row["n_convs"] - 1) * row.pop("n_words")
            if row["parent_id"] is not None:
                above = upper.setdefault(row["parent_id"], [0, 0, 0])
                above[0] += 1
                above[1] += row["n_leaves"]
                above[2] += row["saved_tokens"]
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=OPEN)


OPEN = pa.schema([("id", pa.binary()), ("depth", pa.int64()), ("parent_id", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.binary()), ("n_closed", pa.int64())])
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row for each node of the trie over conv_id and turns (array of hash and n_words): see the contract's columns.

    Nodes are distinct sequences of first turns; conv_id is the smallest of a node's conversations. Copies of a sequence
    are counted before the trie is built and so never meet in it. A conversation without turns is a member of the root. No
    conversations give no nodes. A task holds the words and common prefixes of its range of distinct keys; the open nodes are
    at most two ways down for each range, and only their sums pass through one task, one depth at a time.
    """
    spark = seqs.sparkSession
    n = shuffle_partitions(spark)
    keys = stored(keyed(seqs))
    one_each = keys.groupBy("id").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"))
    distinct = one_each.join(end_lists(keys), "id").select("key", "n_words", "conv_id", "n", "ends")
    nodes = stored(distinct.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(forests, NODE_SCHEMA))
    merged = nodes.where("open").groupBy("id", "depth").agg(F.min("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("n_words").alias("n_words"), F.max("ends").alias("ends"))
    summed = stored(merged.repartition(1).sortWithinPartitions(F.desc("depth"), "id").mapInArrow(sums_upwards, "id binary, depth long, parent_id binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, n_closed long"))
    parents = summed.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), "n_closed")
    closed = nodes.where("not open")
    found = closed.where("parent_id is null").select(*RESULT)
    found = found.unionByName(hot_join(closed.where("parent_id is not null").drop("parent_conv_id"), parents.where("n_closed > 0"), ["parent_id"], "n_closed").select(*RESULT))
    found = found.unionByName(summed.join(parents.drop("n_closed"), "parent_id", "left").select(*RESULT))
    return found.select(*RESULT[:-1], F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256"))
