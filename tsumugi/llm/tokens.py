"""Token counts (operator 8): rank-synchronous merging of ragged symbol arrays.

A batch's distinct pre-tokens lie end to end in one array of symbol ids. In each round every pre-token finds the lowest
rank among its adjacent pairs, and all pre-tokens merge that pair at the same time; when no pair of the vocabulary is
left, the symbols that survive are counted. A symbol without a piece counts its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tsumugi.llm.common import GOLDEN, MIX_1, MIX_2, giving_way, rows_of, unused

SPACE = "▁"
NONE = np.int64(1 << 40)


class Merges:
    """The merge table of a sentencepiece BPE model with byte fallback and an identity normaliser."""

    #: Distinct pre-tokens kept with their counts, by each Python worker.
    CACHE = 200_000
    #: Symbols merged in one array at a time.
    BATCH = 1 << 18

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        odd = [p for p in pieces if SPACE in p[1:] and p.strip(SPACE)]
        if odd:
            raise ValueError(f"pieces with an inner space mark aren't supported: {odd[:3]}")
        self.symbols = {p: k for k, p in enumerate(pieces)}  # a symbol's id
        self.n = len(pieces)
        rank = {p: k for k, p in enumerate(sorted((p for p in pieces if len(p) > 1), key=pieces.get))}
        pairs = {}  # (left, right) -> (rank, merged)
        for p, r in rank.items():
            for i in range(1, len(p)):
                left, right = self.symbols.get(p[:i]), self.symbols.get(p[i:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = (r, self.symbols[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.place()
        self.by_char = np.full(0x110000, -1, np.int32)  # a code point's symbol
        for p, k in self.symbols.items():
            if len(p) == 1:
                self.by_char[ord(p)] = k
        joined = {c for p in rank for c in p}
        self.alone = frozenset(p for p in "\n\t\r" if p not in joined)
        own = "".join(map(re.escape, sorted(self.alone)))
        self.split = re.compile(f"[{own}]|{SPACE}*[^{own}{SPACE}]+|{SPACE}+" if own else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.cache: dict[str, int] = {}

    def place(self) -> None:
        """Hash tables of the pairs: each key is at its slot of the first table or, if that is taken, of the second."""
        slots = (self.keys.astype(np.uint64) * GOLDEN) >> np.uint64(44)
        self.first = np.zeros(1 << 20, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        rest = np.flatnonzero(self.first[slots] != np.arange(len(slots)))
        self.multiplier = MIX_1
        with np.errstate(over="ignore"):
            while len(np.unique(slots := (self.keys[rest].astype(np.uint64) * self.multiplier) >> np.uint64(44))) < len(rest):
                self.multiplier = self.multiplier * MIX_2 | np.uint64(1)
        self.second = np.zeros(1 << 20, np.int32)
        self.second[slots] = rest

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the two don't merge) and merged symbol of each pair; symbols below 0 have no piece."""
        key = left * self.n + right
        key[(left < 0) | (right < 0)] = -1
        wide = key.astype(np.uint64)
        at = self.first[(wide * GOLDEN) >> np.uint64(44)]
        hit = self.keys[at] == key
        rest = np.flatnonzero(~hit)
        at[rest] = other = self.second[(wide[rest] * self.multiplier) >> np.uint64(44)]
        hit[rest] = self.keys[other] == key[rest]
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def survivors(self, tokens: list[str]) -> np.ndarray:
        """The number of model tokens of each pre-token."""
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, owner = self.by_char[points].astype(np.int64), np.repeat(np.arange(len(tokens)), sizes)
        bare = np.flatnonzero(symbols < 0)
        n_bytes = 1 + (points[bare] > 0x7F) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF).astype(np.int64)
        out = np.bincount(owner[bare], weights=n_bytes, minlength=len(tokens)).astype(np.int64)
        rank, merged = self.rank_of(symbols, np.r_[symbols[1:], -1])  # of each symbol with the next
        rank[np.flatnonzero(owner[1:] != owner[:-1])] = NONE
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            span = np.repeat(best, np.diff(np.r_[first, len(owner)]))
            ended = span == NONE
            if ended.any():  # pre-tokens without a pair left leave the arrays
                out += np.bincount(owner[ended & (symbols >= 0)], minlength=len(tokens))
                symbols, owner, rank, merged, span = (x[~ended] for x in (symbols, owner, rank, merged, span))
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == span)
            chosen = chosen[self.apart(chosen)]
            chosen = chosen[self.before_better(chosen, symbols, owner, rank, merged)]
            symbols[chosen] = merged[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            at = (np.cumsum(keep) - 1)[chosen]
            symbols, owner, rank, merged = (x[keep] for x in (symbols, owner, rank, merged))
            new = np.r_[at, at[at > 0] - 1]  # only pairs with a new symbol have a new rank
            after = np.minimum(new + 1, len(symbols) - 1)
            rank[new], merged[new] = self.rank_of(symbols[new], np.where((new + 1 < len(symbols)) & (owner[after] == owner[new]), symbols[after], -1))
        return out

    @staticmethod
    def apart(chosen: np.ndarray) -> np.ndarray:
        """Of occurrences that overlap (a run of one symbol), the first, third and so on, as a merge from the left takes them."""
        if not len(chosen):
            return np.empty(0, bool)
        start = np.r_[True, np.diff(chosen) != 1]
        begin = np.flatnonzero(start)
        return (np.arange(len(chosen)) - np.repeat(begin, np.diff(np.r_[begin, len(chosen)]))) % 2 == 0

    def before_better(self, chosen: np.ndarray, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Which occurrences a one-at-a-time merge would take before a new pair of lower rank arises.

        That is each pre-token's occurrences up to the first whose merged symbol makes a pair of lower rank with the symbol
        on its left (itself merged, if that is the occurrence before) or on its right.
        """
        new = merged[chosen]
        at, after = chosen - 1, chosen + 2
        has_left = (at >= 0) & (owner[np.maximum(at, 0)] == owner[chosen])
        neighbour = symbols[np.maximum(at, 0)]
        joined = np.r_[False, chosen[1:] == chosen[:-1] + 2] if len(chosen) else np.empty(0, bool)
        neighbour = np.where(joined, np.r_[-1, new[:-1]] if len(new) else new, neighbour)
        has_right = (after < len(symbols)) & (owner[np.minimum(after, len(symbols) - 1)] == owner[chosen])
        r_left, _ = self.rank_of(np.where(has_left, neighbour, -1), new)
        r_right, _ = self.rank_of(new, np.where(has_right, symbols[np.minimum(after, len(symbols) - 1)], -1))
        better = (np.minimum(r_left, r_right) < rank[chosen]).astype(np.int64)
        whose = owner[chosen]
        start = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else np.empty(0, np.int64)
        before = np.cumsum(better) - better
        return before - np.repeat(before[start], np.diff(np.r_[start, len(whose)])) == 0

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text, as the library's encode() gives them."""
        cache, split = self.cache, self.split
        parts = [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({p for ps in parts for p in ps if p not in cache})
        if len(cache) + len(new) > self.CACHE:
            cache.clear()
            new = list({p for ps in parts for p in ps})
        new.sort(key=len)
        start = size = 0
        for k, p in enumerate(new):
            size += len(p)
            if size >= self.BATCH or k == len(new) - 1:
                some = new[start : k + 1]
                cache.update(zip(some, self.survivors(some).tolist(), strict=True))
                start, size = k + 1, 0
        get = cache.__getitem__
        return [sum(map(get, ps)) for ps in parts]


SCHEMA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
_loaded: dict[str, Merges] = {}


def loaded(model_file: str) -> Merges:
    if model_file not in _loaded:
        _loaded[model_file] = Merges(model_file)
    return _loaded[model_file]


def count_tokens(docs: DataFrame, model_file: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_bytes and n_tokens of each row of docs; the model file must be at that path on every executor.

    One row a document, in one pass without a shuffle. A null or empty text has 0 bytes and 0 tokens; repeated rows give
    repeated results; a text of any length is counted whole; other columns of docs aren't read; a key
    named like a result gives way.
    """
    keys = giving_way(keys, SCHEMA.names)
    one = docs.select(*[docs[k].alias(k) for k in keys], docs[text].alias(unused("_text", keys)))
    schema = T.StructType([*one.schema.fields[:-1], *SCHEMA.fields])
    arrow, own_text = [f.name for f in schema.fields], [one.columns[-1]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(model_file)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for (texts,) in rows_of(iter([batch]), own_text):
                n_bytes += [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                n_tokens += merges.counts(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=arrow)

    return one.mapInArrow(kernel, schema)
