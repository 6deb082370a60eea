"""Surface-forced decoding: which tokens may follow while written form, reading, lemma and canonical form are generated."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import regex

from tsumugi.vocab import CANON, DELIMITER, HALF_SPACE, LEMMA, NO_CANON, READING, SPECIAL_TO_RARE, SURF

PIECE = "▁"
KANJI_OR_KATAKANA = regex.compile(r"[\p{Script=Han}\p{Script=Katakana}]")


def reading_candidates(vocab: Mapping[str, int], pad: str, eos: str) -> list[int]:
    """Tokens that a reading may hold: none with kanji or katakana, no control tokens."""
    control = {pad, eos, SURF, READING, LEMMA, CANON, NO_CANON, DELIMITER}
    return [k for t, k in vocab.items() if t not in control and not KANJI_OR_KATAKANA.search(t)]


def by_first_character(vocab: Mapping[str, int]) -> dict[str, dict[str, int]]:
    """Tokens by their first character, a leading piece mark aside; the mark alone is left out."""
    out: dict[str, dict[str, int]] = {}
    for t, k in vocab.items():
        bare = t.removeprefix(PIECE)
        if bare:
            out.setdefault(bare[0], {})[t] = k
    return out


class Forced:
    """The state machine for one sequence; allowed() gives the token ids that may come next."""

    def __init__(self, surfs: Sequence[str], vocab: Mapping[str, int], decode: Callable[[Sequence[int]], str], pad: str = "<pad>", eos: str = "</s>"):
        self.surfs, self.vocab, self.decode = list(surfs), vocab, decode
        self.pad, self.eos = vocab[pad], vocab[eos]
        self.by_char = by_first_character(vocab)
        self.readings = reading_candidates(vocab, pad, eos)
        self.everything = frozenset(vocab.values())
        self.finished = False

    def section(self, ids: Sequence[int]) -> str | None:
        """The control token that the sequence is within."""
        names = {self.vocab[t]: t for t in (SURF, READING, LEMMA, CANON)}
        return next((names[i] for i in reversed(ids) if i in names), None)

    def rest_of_surf(self, ids: Sequence[int]) -> str:
        """What of the current written form hasn't been generated."""
        done, part = 0, ""
        for piece in self.decode(ids).split(SURF):
            if READING in piece:
                done += 1
            else:
                part = piece.strip(" ")
        return self.surfs[done][len(part) :]

    def tokens_for(self, rest: str) -> set[int]:
        """Tokens with which the rest of a written form may begin; a special token stands alone."""
        special = next((t for t in (HALF_SPACE, *SPECIAL_TO_RARE) if rest.startswith(t)), None)
        if special:
            return {self.vocab[special]}
        return {k for t, k in self.by_char.get(rest[0], {}).items() if rest.startswith(t) or rest.startswith(t.removeprefix(PIECE))}

    def allowed(self, ids: Sequence[int], best: int | None = None) -> set[int]:
        """ids: the tokens so far, the start token first. best: the model's own choice, which may end a whole sequence."""
        v = self.vocab
        if len(ids) == 1:
            return {v[SURF]}
        if self.finished:
            return {self.eos}
        section, last = self.section(ids), ids[-1]
        if section == SURF:
            rest = self.rest_of_surf(ids)
            return self.tokens_for(rest) if rest else {v[READING]}
        if section == READING:
            return {*self.readings} if last == v[READING] else {*self.readings, v[LEMMA]}
        if section == LEMMA:
            barred = {self.pad, self.eos, *(v[t] for t in (SURF, READING, LEMMA, NO_CANON, DELIMITER))}
            return set(self.everything - (barred | {v[CANON]} if last == v[LEMMA] else barred))
        barred = {self.pad, *(v[t] for t in (READING, LEMMA, CANON, DELIMITER))}
        if last == v[CANON]:
            barred |= {self.eos, v[SURF]}
        elif list(ids).count(v[READING]) < len(self.surfs):
            barred |= {self.eos, v[NO_CANON]}
        else:
            barred |= {v[SURF], v[NO_CANON]}
            self.finished = self.finished or best == self.eos
        return set(self.everything - barred)
