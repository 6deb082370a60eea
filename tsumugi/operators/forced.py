"""Surface-forced decoding on tables: which tokens may come next in sequences of written forms, readings, lemmas and canonical forms.

A vocabulary is a table of tokens and ids. Tokens with which the rest of a written form may begin are found by its prefixes: an
equal join on them, as many as the longest token has characters, instead of a comparison with every token. Inside a
predictor, the same index is an array that tasks hold (a vocabulary is bounded by a parameter), and the state machine steps
many sequences at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.arrow import batch
from tsumugi.kernels.forced import KANJI_OR_KATAKANA, PIECE
from tsumugi.vocab import CANON, DELIMITER, HALF_SPACE, LEMMA, NO_CANON, READING, SPECIAL_TO_RARE, SURF

#: Tokens that stand alone at the start of a written form, in the order in which they are tried.
ALONE = (HALF_SPACE, *SPECIAL_TO_RARE)
#: Tokens of a vocabulary at most, where tasks hold it.
MOST_TOKENS = 1 << 20


# --- tables


def reading_tokens(vocab: DataFrame, pad: str = "<pad>", eos: str = "</s>") -> DataFrame:
    """Those tokens (token, id) that a reading may hold: none with kanji or katakana, no control tokens."""
    control = [pad, eos, SURF, READING, LEMMA, CANON, NO_CANON, DELIMITER]
    return vocab.where(~F.col("token").isin(control) & ~F.col("token").rlike(r"[\p{IsHan}\p{IsKatakana}]"))


def first_characters(vocab: DataFrame) -> DataFrame:
    """character and tokens (a map from token to id) of the tokens by their first character, a leading piece mark aside."""
    bare = F.regexp_replace("token", f"^{PIECE}", "")
    own = vocab.withColumn("character", F.substring(bare, 1, 1)).where(bare != "")
    return own.groupBy("character").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id")))).alias("tokens"))


def prefix_index(vocab: DataFrame) -> DataFrame:
    """match, bare, token and id: a token begins a rest that begins with match, which is the token itself or what follows its piece mark (bare)."""
    bare = F.regexp_replace("token", f"^{PIECE}", "")
    own = vocab.withColumn("bare", bare).where("bare != ''")
    # a token that is found by its own piece mark must have that mark for its first character too
    twice = F.when(F.startswith("token", F.lit(PIECE)) & F.startswith("bare", F.lit(PIECE)), F.array("bare", "token")).otherwise(F.array("bare"))
    return own.select(F.explode(F.array_distinct(twice)).alias("match"), "bare", "token", "id")


def permitted_tokens(rests: DataFrame, vocab: DataFrame, rest: str = "rest") -> DataFrame:
    """rests' rows with token and id, for each token with which the rest of a written form may begin; a special token stands alone.

    A rest has one row for each of its prefixes up to the longest token's length, which meets the vocabulary by an equal join. The
    vocabulary is a parameter and goes to the rests: short prefixes are so frequent that they must not be brought together.
    """
    index = prefix_index(vocab.select("token", "id").distinct())
    longest = index.agg(F.max(F.length("match"))).first()[0] or 1
    special = F.coalesce(*[F.when(F.startswith(rest, F.lit(t)), F.lit(t)) for t in ALONE])
    own = rests.withColumn("_special", special)
    alone = own.where("_special is not null").join(F.broadcast(vocab.where(F.col("token").isin(*ALONE)).select(F.col("token").alias("_special"), F.col("token"), "id")), "_special")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length(rest), F.lit(longest))), lambda n: F.substring(F.col(rest), F.lit(1), n))
    others = own.where(f"_special is null and {rest} != ''").withColumn("match", F.explode(prefixes)).join(F.broadcast(index), "match")
    once = others.where((F.col("match") == F.col("bare")) | ~F.startswith(rest, F.col("bare")))  # a token that has two matches
    return alone.select(*rests.columns, "token", "id").unionByName(once.select(*rests.columns, "token", "id"))


def section(tokens: Column | str) -> Column:
    """The control token that a sequence of tokens is within: the last one of the four."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.try_element_at(F.filter(c, lambda t: t.isin(SURF, READING, LEMMA, CANON)), F.lit(-1))


def rest_of_surf(tokens: Column | str, surfs: Column | str) -> Column:
    """What of the current written form hasn't been generated: without the text since its control token, spaces at its ends aside.

    As many written forms are done as readings were begun. Piece marks stand for spaces. Null where all are done.
    """
    c, s = (F.col(x) if isinstance(x, str) else x for x in (tokens, surfs))
    done = F.size(F.filter(c, lambda t: t == READING))
    last = F.size(c) - F.array_position(F.reverse(c), SURF).cast("int") + 1
    text = F.replace(F.array_join(F.when(F.array_contains(c, SURF), F.slice(c, last + 1, F.size(c) - last)).otherwise(F.slice(c, 1, 0)), ""), F.lit(PIECE), F.lit(" "))
    surf = F.get(s, done)
    return F.substring(surf, F.length(F.trim(text)) + 1, F.length(surf))


# --- many sequences at a time


class Machine:
    """The state machine over a vocabulary: sets of tokens as rows of one boolean table, so that a step is a table look-up for all sequences.

    States that don't depend on a sequence's own text have a fixed row; those within a written form get theirs from the prefix
    index, and each distinct rest of a batch is worked out once.
    """

    def __init__(self, tokens: Sequence[str], pad: str = "<pad>", eos: str = "</s>"):
        if len(tokens) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} tokens")
        self.tokens, self.ids = list(tokens), {t: k for k, t in enumerate(tokens)}
        self.pad, self.eos = self.ids[pad], self.ids[eos]
        self.control = np.array([self.ids[t] for t in (SURF, READING, LEMMA, CANON)])
        self.by_prefix: dict[str, list[int]] = {}
        self.longest = 1
        for k, t in enumerate(self.tokens):
            bare = t.removeprefix(PIECE)
            for match in {bare, t} if t.startswith(PIECE) and bare.startswith(PIECE) else {bare}:
                if match:
                    self.by_prefix.setdefault(match, []).append(k)
                    self.longest = max(self.longest, len(match))
        none, every = np.zeros(len(tokens), bool), np.ones(len(tokens), bool)
        only = lambda *of: self.changed(none, of, True)
        barred = lambda *of: self.changed(every, of, False)
        readings = np.array([t not in (pad, eos, SURF, READING, LEMMA, CANON, NO_CANON, DELIMITER) and not KANJI_OR_KATAKANA.search(t) for t in self.tokens])
        self.rows = {
            "first": only(SURF), "end": only(eos), "to reading": only(READING), "reading": readings, "to lemma": self.changed(readings, (LEMMA,), True),
            "lemma": barred(pad, eos, SURF, READING, LEMMA, NO_CANON, DELIMITER, CANON), "to canon": barred(pad, eos, SURF, READING, LEMMA, NO_CANON, DELIMITER),
            "canon": barred(pad, READING, LEMMA, CANON, DELIMITER, eos, SURF), "to surf": barred(pad, READING, LEMMA, CANON, DELIMITER, eos, NO_CANON), "to end": barred(pad, READING, LEMMA, CANON, DELIMITER, SURF, NO_CANON),
        }

    def changed(self, row: np.ndarray, tokens: Sequence[str], value: bool) -> np.ndarray:
        out = row.copy()
        out[[self.ids[t] for t in tokens if t in self.ids]] = value
        return out

    def begins(self, rest: str) -> np.ndarray:
        """The tokens with which a rest of a written form may begin."""
        out = np.zeros(len(self.tokens), bool)
        special = next((t for t in ALONE if rest.startswith(t)), None)
        found = [self.ids[special]] if special else [k for n in range(1, min(len(rest), self.longest) + 1) for k in self.by_prefix.get(rest[:n], ())]
        out[found] = True
        return out

    def states(self, surfs: list[list[str]], ids: list[np.ndarray]) -> Iterator[str | tuple[str]]:
        """For each sequence the name of its row, or the rest of its written form in a tuple."""
        lengths = np.array([len(x) for x in ids])
        flat, row = np.concatenate([np.empty(0, np.int64), *ids]), np.repeat(np.arange(len(ids)), lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        within = np.full(len(ids), -1)
        is_control = np.isin(flat, self.control)
        within[row[is_control]] = flat[is_control]  # the last one of a row stays
        begun = np.full(len(ids), -1)
        is_surf = flat == self.ids[SURF]
        begun[row[is_surf]] = at[is_surf]
        done = np.bincount(row[flat == self.ids[READING]], minlength=len(ids))
        surf, reading, lemma, canon = self.control
        for k, own in enumerate(ids):
            last = own[-1] if len(own) else -1
            if len(own) <= 1:
                yield "first"
            elif within[k] == surf:
                text = "".join(self.tokens[i] for i in own[begun[k] + 1 :]).replace(PIECE, " ").strip(" ")
                rest = surfs[k][done[k]][len(text) :] if done[k] < len(surfs[k]) else ""
                yield (rest,) if rest else "to reading"
            elif within[k] == reading:
                yield "reading" if last == reading else "to lemma"
            elif within[k] == lemma:
                yield "lemma" if last == lemma else "to canon"
            else:
                yield "canon" if last == canon else "to surf" if done[k] < len(surfs[k]) else "to end"

    def masks(self, surfs: list[list[str]], ids: list[np.ndarray], finished: np.ndarray | None = None) -> np.ndarray:
        """A row of the allowed tokens for each sequence: its written forms, its tokens so far (the start token first), and whether it is over."""
        rests: dict[str, np.ndarray] = {}
        out = np.empty((len(ids), len(self.tokens)), bool)
        for k, state in enumerate(self.states(surfs, ids)):
            if finished is not None and finished[k]:
                state = "end"
            if isinstance(state, tuple):
                if state[0] not in rests:
                    rests[state[0]] = self.begins(state[0])
                out[k] = rests[state[0]]
            else:
                out[k] = self.rows[state]
        return out

    def step(self, scores: np.ndarray, surfs: list[list[str]], ids: list[np.ndarray], finished: np.ndarray) -> np.ndarray:
        """The best allowed token of each sequence; finished is brought up to date: a sequence is over once its own choice at its end is the end token."""
        states = list(self.states(surfs, ids))
        masks = self.masks(surfs, ids, finished)
        finished |= np.array([s == "to end" for s in states]) & (scores.argmax(axis=1) == self.eos)
        return np.where(masks, scores, -np.inf).argmax(axis=1)


def allowed_tokens(tokens: Sequence[str], pad: str = "<pad>", eos: str = "</s>", step: int = 256):
    """A column function of surfs (array<string>) and ids (array<int>, the start token first): the ids that may come next, in order."""
    machine: list[Machine] = []

    @batch("array<int>")
    def allowed(surfs: pa.Array, ids: pa.Array) -> pa.Array:
        if not machine:
            machine.append(Machine(tokens, pad, eos))
        out = []
        for at in range(0, len(ids), step):
            s, i = surfs.slice(at, step).to_pylist(), ids.slice(at, step).to_pylist()
            known = [k for k in range(len(i)) if s[k] is not None and i[k] is not None]
            masks = machine[0].masks([s[k] for k in known], [np.array(i[k], np.int64) for k in known])
            found: list[list[int] | None] = [None] * len(i)
            for k, mask in zip(known, masks, strict=True):
                found[k] = np.flatnonzero(mask).tolist()
            out += found
        return pa.array(out, pa.list_(pa.int32()))

    return allowed
