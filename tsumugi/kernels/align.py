"""Alignments: of surface pieces with a reading, of two segmentations, and morphological differences."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from collections.abc import Mapping, Sequence

from tsumugi.kernels.norm import removable
from tsumugi.vocab import HIRAGANA, KATAKANA, PROLONGED_E, PROLONGED_MARKS, PROLONGED_VOWEL, SMALL_TO_LARGE, VOICED_TO_VOICELESS

TO_HIRAGANA = str.maketrans(KATAKANA, HIRAGANA)
#: Kana that a piece's reading seldom starts with; kanji readings whose last kana may become っ (fixed values).
SELDOM_FIRST = frozenset("ぁぃぅぇぉゃゅょっんー")
ASSIMILATED = frozenset("きくちつ")


def expand_readings(readings: Sequence[str]) -> list[str]:
    """Dictionary readings without hyphens; of base.ending the base and the base with each proper prefix of the ending."""
    out: list[str] = []
    for r in readings:
        base, dot, ending = r.replace("-", "").partition(".")
        out += [base, *(base + ending[:k] for k in range(1, len(ending)))] if dot else [base]
    return list(dict.fromkeys(out))


def piece_costs(surf: str, i: int, reading: str, j: int, kanji: Sequence[str]) -> dict[int, int]:
    """Cost by length of reading that character i may take from place j on."""
    c, before = surf[i], surf[i - 1] if i else ""
    out: dict[int, int] = {}

    def offer(width: int, cost: int) -> None:
        out[width] = min(cost, out.get(width, cost))

    if j < len(reading):
        r = reading[j]
        if c.translate(TO_HIRAGANA) == r:
            offer(1, 0)
        if VOICED_TO_VOICELESS.get(c) == r or SMALL_TO_LARGE.get(c) == r:
            offer(1, 1)
        if before and c in PROLONGED_MARKS and r in (PROLONGED_VOWEL.get(before), PROLONGED_E.get(before)):
            offer(1, 2)
        for k in kanji:
            part = reading[j : j + len(k)]
            if not k or len(part) < len(k):
                continue
            if part == k:
                offer(len(k), 0)
            elif VOICED_TO_VOICELESS.get(part[0], part[0]) + part[1:] == k or (k[-1] in ASSIMILATED and part == k[:-1] + "っ"):
                offer(len(k), 10)
        first = 500 if r in SELDOM_FIRST else 0
        for width in range(1, len(reading) - j + 1):
            offer(width, first + 1000 * int(width**1.5))
    offer(0, 500 if removable(c) or unicodedata.category(c)[0] != "L" else 5000)
    return out


def align_reading(pieces: Sequence[str], reading: str, kanji: Mapping[str, Sequence[str]]) -> list[str]:
    """The reading of each piece of a word, by the cheapest path through the lattice of characters and readings.

    kanji gives the expanded readings of a character; 々 takes those of the character before. A small kana or prolonged
    mark may join the character before it within its piece, for 10. An empty first piece reads as nothing.
    """
    if len(pieces) == 1:
        return [reading]
    empty = pieces[0] == ""
    own = list(pieces[1:] if empty else pieces)
    surf, n = "".join(own), len(reading)
    ends, total = set(), 0
    for p in own:
        total += len(p)
        ends.add(total)
    best: dict[tuple[int, int], tuple[int, tuple[int, int] | None]] = {(0, 0): (0, None)}
    for i in range(len(surf)):
        readings = kanji.get(surf[i], kanji.get(surf[i - 1], ()) if i and surf[i] == "々" else ())
        for j in range(n + 1):
            if (i, j) not in best:
                continue
            so_far = best[i, j][0]
            for width, cost in piece_costs(surf, i, reading, j, readings).items():
                to, price = i + 1, so_far + cost
                while True:
                    if price < best.get((to, j + width), (float("inf"), None))[0]:
                        best[to, j + width] = (price, (i, j))
                    if width == 0 or to in ends or to >= len(surf) or not removable(surf[to]):
                        break
                    to, price = to + 1, price + 10
    if (len(surf), n) not in best:
        raise ValueError(f"{reading!r} doesn't align with {pieces!r}")
    cut = {}
    at: tuple[int, int] | None = (len(surf), n)
    while at is not None:
        cut[at[0]] = at[1]
        at = best[at][1]
    out, start = [""] if empty else [], 0
    total = 0
    for p in own:
        total += len(p)
        out.append(reading[start : cut[total]])
        start = cut[total]
    return out


def align_segmentations(a: Sequence[str], b: Sequence[str], most: int = 10) -> list[tuple[int, int, int, int]] | None:
    """Smallest stretches (a1, a2, b1, b2) of at most most pieces whose texts agree, in order; None if a stretch has none.

    Stretches end where both segmentations have a boundary; what follows the end of the shorter one isn't aligned.
    """
    out = []
    i = j = 0
    while i < len(a) and j < len(b):
        u, v, x, y = i + 1, j + 1, len(a[i]), len(b[j])
        while x != y:
            if x < y:
                if u >= len(a):
                    return None
                x, u = x + len(a[u]), u + 1
            else:
                if v >= len(b):
                    return None
                y, v = y + len(b[v]), v + 1
        if "".join(a[i:u]) != "".join(b[j:v]) or u - i > most or v - j > most:
            return None
        out.append((i, u, j, v))
        i, j = u, v
    return out


KEYS = ("surf", "reading", "lemma", "canon")


def morphology_counts(system: Sequence[tuple[str, str, str, str]], gold: Sequence[tuple[str, str, str, str]]) -> dict[str, tuple[int, int, int]]:
    """True positives, false positives and false negatives of surf, reading, lemma and canon over one sentence.

    Rows that a diff leaves in place are right in all; where it doesn't, stretches of equal length are compared: a pair of
    equal written forms is judged field by field, other stretches are wrong in all.
    """
    tp, fp, fn = Counter(), Counter(), Counter()

    def judge(right: set[str], n_system: int, n_gold: int) -> None:
        for k in KEYS:
            if k in right:
                tp[k] += n_system
            else:
                fp[k] += n_system
                fn[k] += n_gold

    for kind, i1, i2, j1, j2 in difflib.SequenceMatcher(None, list(system), list(gold), autojunk=False).get_opcodes():
        if kind == "equal":
            judge(set(KEYS), i2 - i1, j2 - j1)
            continue
        i, j = i1, j1
        while i < i2 and j < j2:
            if system[i][0] == gold[j][0]:
                judge({k for k, x, y in zip(KEYS, system[i], gold[j], strict=True) if x == y}, 1, 1)
                i, j = i + 1, j + 1
                continue
            u, v, x, y = i + 1, j + 1, len(system[i][0]), len(gold[j][0])
            while x != y and "".join(r[0] for r in system[u:i2]) != "".join(r[0] for r in gold[v:j2]):
                if x > y and v < j2:
                    y, v = y + len(gold[v][0]), v + 1
                elif x < y and u < i2:
                    x, u = x + len(system[u][0]), u + 1
                else:
                    break
            judge(set(), u - i, v - j)
            i, j = u, v
        judge(set(), i2 - i, j2 - j)
    return {k: (tp[k], fp[k], fn[k]) for k in KEYS}
