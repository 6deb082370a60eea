"""Spelling variant grouping (operator 13): words that are one insertion, deletion or replacement of a code point apart.

Words are arranged in a trie by how many letters of each group they have, one group a level. One edit takes at most one
letter out of one group and puts at most one into another, so all words near a given one are found by going down with a
budget of one surplus and one deficit; the words at the leaves that are reached are compared. Of two near words, the search
starts from the one with fewer letters at the first level at which they differ: its surplus comes before its deficit. The trie is cut into subtrees
below its first levels, one a task; subtrees of more than MOST words are cut again below further levels. The search through
the levels above the cuts is a join: words meet the subtrees that their budget lets them reach.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import hot_join, rows_of, shuffle_partitions, stored

#: Letter groups, one a level; letters that are in none make up the last level.
GROUPS = ("e", "t", "n", "i", "a", "o", "r", "s", "h", "d", "l", "c", "u", "m", "g", "b", "fp", "kvw", "jqxyz")
LEVELS = len(GROUPS) + 1
#: Levels above each cut, words of a subtree at most, words of a leaf that are compared one by one, distinct words that a counting task holds.
CUTS, MOST, FEW, HELD = (4, 9, LEVELS), 20_000, 4, 200_000
RUN = re.compile("[a-zÀ-ÿ]+")
_level = {ord(c): chr(k) for k, group in enumerate(GROUPS) for c in group} | {c: chr(LEVELS - 1) for c in [*range(0xC0, 0x100)]}
_marks = [chr(k) for k in range(LEVELS)]


def letter_counts(word: str) -> list[int]:
    """How many letters of each group a word has."""
    return list(map(word.translate(_level).count, _marks))


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    more = len(a) - len(b)
    if not more:
        return sum(map(ne, a, b)) == 1
    if more not in (1, -1):
        return False
    short, long = (b, a) if more == 1 else (a, b)
    at = next((k for k, c in enumerate(short) if c != long[k]), len(short))
    return long[at + 1 :] == short[at:]


def lower_runs(text: str) -> list[str]:
    """The maximal runs of letters, with only A to Z lower-cased."""
    return RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def misspelt(doc_id: int | None, run: str, every: int) -> str:
    """The run, without one code point where the CRC-32 of id and run is divisible by every."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "surrogatepass"))
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word and n: distinct words of at least least_length code points that occur at least least_count times in all texts.

    Null texts have no words, a null doc_id counts as an empty one, repeated rows count again. Each task adds up what it can
    hold, so that a frequent word is one row a task.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
        for ids, texts in rows_of(batches, ["doc_id", "text"]):
            for doc_id, text in zip(ids, texts, strict=True):
                for run, n in Counter(lower_runs(text or "")).items():
                    if len(run) >= least_length:
                        held[misspelt(doc_id, run, every)] += n
            if len(held) > HELD:
                yield batch()
                held.clear()
        yield batch()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def reachable(counts: list[int], levels: range, plus: int, minus: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """The counts at these levels that a budget reaches, each with what is left of it. The deficit is there once the surplus is spent."""
    own = tuple(counts[k] for k in levels)
    yield own, plus, minus
    if plus:
        for k in range(len(own)):
            more = own[:k] + (own[k] + 1,) + own[k + 1 :]
            yield more, 0, 1
            for j in range(k + 1, len(own)):
                if own[j]:
                    yield more[:j] + (own[j] - 1,) + more[j + 1 :], 0, 0
    elif minus:
        for k in range(len(own)):
            if own[k]:
                yield own[:k] + (own[k] - 1,) + own[k + 1 :], 0, 0


def written(counts: tuple[int, ...] | list[int]) -> str:
    return "".join(f"{n}." for n in counts)


class Leaf:
    """Words at one place of the trie. Few are compared one by one; many have equal letter counts, so one length, and are looked up by what is left without one letter."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words, self.table = words, None

    def matches(self, word: str) -> list[tuple[str, int]]:
        if len(self.words) <= FEW:
            return [w for w in self.words if near(word, w[0])]
        if self.table is None:
            self.table = {}
            for w in self.words:
                self.table.setdefault(w[0], []).append(w)
                for k in range(len(w[0])):
                    self.table.setdefault((k, w[0][:k] + w[0][k + 1 :]), []).append(w)
                for rest in {w[0][:k] + w[0][k + 1 :] for k in range(len(w[0]))}:
                    self.table.setdefault((rest,), []).append(w)
        length = len(self.words[0][0])
        if len(word) == length:
            return [w for k in range(length) for w in self.table.get((k, word[:k] + word[k + 1 :]), ()) if w[0] != word]
        if len(word) == length + 1:
            return [w for rest in {word[:k] + word[k + 1 :] for k in range(len(word))} for w in self.table.get(rest, ())]
        return self.table.get((word,), []) if len(word) == length - 1 else []


def grown(words: list[tuple[str, int, list[int]]], level: int) -> dict | Leaf:
    """The trie below a level: counts to subtrees; a place with few words is a leaf already."""
    if len(words) <= FEW or level == LEVELS:
        return Leaf([w[:2] for w in words])
    below: dict[int, list] = {}
    for w in words:
        below.setdefault(w[2][level], []).append(w)
    return {count: grown(some, level + 1) for count, some in below.items()}


def search(node: dict | Leaf, level: int, word: str, counts: list[int], plus: int, minus: int) -> Iterator[tuple[str, int, bool]]:
    """The words near a word below a place of the trie, depth first, with what is left of the budget; and whether any of it was spent."""
    stack = [(node, level, plus, minus)]
    while stack:
        node, level, plus, minus = stack.pop()
        if isinstance(node, Leaf):
            for other, n in node.matches(word):
                yield other, n, not plus
            continue
        own = counts[level]
        below = node.get(own)
        if below is not None:
            stack.append((below, level + 1, plus, minus))
        if plus:
            below = node.get(own + 1)
            if below is not None:
                stack.append((below, level + 1, 0, 1))
        elif minus:
            below = node.get(own - 1)
            if below is not None:
                stack.append((below, level + 1, 0, 0))


PLACE = "key string, word string, n long, plus int, minus int"
PLACE_ARROW = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("plus", pa.int32()), ("minus", pa.int32())])
RESULT = "word string, n long, n_near long, form string, form_n long"
RESULT_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def places(words: DataFrame, above: int, levels: int, searching: bool) -> DataFrame:
    """Where words stand in the trie cut below so many levels (key is where they stand above), or where their budgets reach."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows_of(batches, ["key", "word", "n", "plus", "minus"], most=1024):
            out: list[list] = [[] for _ in PLACE_ARROW]
            for key, word, n, plus, minus in zip(*columns, strict=True):
                counts = letter_counts(word)
                reached = reachable(counts, range(above, levels), plus, minus) if searching else [(counts[above:levels], plus, minus)]
                for at, p, m in reached:
                    for column, value in zip(out, (key + written(at), word, n, p, m), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PLACE_ARROW, strict=True)], schema=PLACE_ARROW)

    return words.select("key", "word", "n", "plus", "minus").mapInArrow(kernel, PLACE)


def near_in_subtrees(members: DataFrame, queries: DataFrame, levels: int) -> DataFrame:
    """word, n, and a near word with its n, for each that queries reach in a subtree. Queries stream past a subtree's words.

    Words whose budget wasn't spent stand at the same place and both find the other; else just one of them does.
    """
    both = members.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True)))
    ordered = both.repartition(shuffle_partitions(members.sparkSession), "key", "piece").sortWithinPartitions("key", "piece", "query").select("key", "piece", "query", "word", "n", "plus", "minus")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, trie = None, [], None
        for columns in rows_of(batches, ["key", "piece", "query", "word", "n", "plus", "minus"], most=1024):
            out: list[list] = [[] for _ in RESULT_ARROW]
            for key, piece, query, word, n, plus, minus in zip(*columns, strict=True):
                if (key, piece) != now:
                    now, words, trie = (key, piece), [], None
                counts = letter_counts(word)
                if not query:
                    words.append((word, n, counts))
                    continue
                if trie is None:
                    trie, words = grown(words, levels), []
                for other, m, spent in search(trie, levels, word, counts, plus, minus):
                    for row in ((word, n, 1, other, m), (other, m, 1, word, n))[: 1 + spent]:
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, RESULT_ARROW, strict=True)], schema=RESULT_ARROW)

    return ordered.mapInArrow(kernel, RESULT)


def near_words(words: DataFrame, cuts: tuple[int, ...] = CUTS, most: int = MOST) -> DataFrame:
    """word, n, n_near and the near word of the largest n (form, form_n; of equal ones the first by code points) of each word.

    words has distinct words with their n. A subtree of over most words is cut below the next levels; one that is still so
    large below all levels, words with equal letter counts throughout, is dealt in pieces, each of which meets all that reach it.
    """
    start = words.select(F.lit("").alias("key"), "word", "n", F.lit(1).alias("plus"), F.lit(0).alias("minus"))
    members, searching, found = start, start, []
    for above, levels in zip((0, *cuts), cuts, strict=False):
        standing = stored(places(members, above, levels, searching=False))
        nodes = stored(standing.groupBy("key").agg(F.count("*").alias("size")))
        reached = hot_join(places(searching, above, levels, searching=True), nodes.withColumn("words", F.col("size")), ["key"], "size")
        sized = hot_join(standing, nodes.withColumn("words", F.col("size")), ["key"], "size")
        last = levels == cuts[-1]
        pieces = F.ceil(F.col("words") / most).cast("int")
        here = F.lit(True) if last else F.col("words") <= most
        own = sized.where(here).withColumn("piece", F.pmod(F.xxhash64("word"), pieces).cast("int")).drop("words")
        theirs = reached.where(here).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("words")
        found.append(near_in_subtrees(own, theirs, levels))
        if last or nodes.where(F.col("size") > most).isEmpty():
            break
        members, searching = (stored(df.where(F.col("words") > most).drop("words")) for df in (sized, reached))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    for df in found:
        every = every.unionByName(df)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def grouped_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n: form is the near word of the largest n if that is at least times the word's, root the last of a chain of forms.

    Each form is at least times as frequent, so chains are as long as the logarithm of the largest n, and the number of
    doublings its logarithm. No words give no rows.
    """
    near = near_words(words)
    taken = F.col("form_n") >= times * F.col("n")
    found = stored(near.select("word", F.when(taken, F.col("form")).alias("form"), "n", "n_near", F.when(taken, F.col("form_n")).alias("form_n")))
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    largest, longest = found.agg(F.max("n")).first()[0] or 1, 1
    while times**longest < largest:
        longest += 1
    reach = 1
    while reach < longest:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
