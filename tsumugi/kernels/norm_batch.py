"""Normalization operations inferred for many pairs of written and normal forms at once.

A cell of the alignment table depends on the row of the character before only, so a row is filled for all pairs and all places of the
normal form by a few array operations; the table keeps, for each cell, the least cost with the letter that ties go to.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from tsumugi.vocab import GEMINATES, NORM_IGNORED, PROLONGED_E, PROLONGED_MARKS, PROLONGED_VOWEL, SMALL_TO_LARGE, VOICED_TO_VOICELESS

LETTERS = "DEKPSV"
D, E, K, P, S, V = range(6)
#: More than any cost, and cells of a table at most.
FAR, CELLS = 1 << 20, 1 << 22


@cache
def table(name: str) -> np.ndarray:
    """A mapping of characters as an array by code points: 0 where there is none."""
    pairs = {"voiced": VOICED_TO_VOICELESS, "small": SMALL_TO_LARGE, "vowel": PROLONGED_VOWEL, "e": PROLONGED_E, "mark": dict.fromkeys(PROLONGED_MARKS, "\x01"), "loose": dict.fromkeys({*PROLONGED_MARKS, *GEMINATES, *SMALL_TO_LARGE}, "\x01")}[name]
    out = np.zeros(0x110000, np.int32)
    for a, b in pairs.items():
        out[ord(a)] = ord(b)
    return out


def codes(words: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(words), width), filler, np.int64)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def aligned(surfs: list[str], norms: list[str]) -> list[list[str]]:
    """The operations of each pair; the normal form is neither empty nor longer than the written one."""
    lengths, targets = (np.array([len(w) for w in words]) for words in (surfs, norms))
    n, m = int(lengths.max()), int(targets.max())
    surf, norm = codes(surfs, n, 0), codes(norms, m, 0x10FFFF)
    cost = np.full((n + 1, len(surfs), m + 1), FAR, np.int32)
    op = np.full((n + 1, len(surfs), m + 1), -1, np.int8)
    cost[0, :, 0] = 0
    for i in range(1, n + 1):
        c = surf[:, i - 1]
        diagonal, kept = cost[i - 1, :, :-1], op[i - 1, :, :-1] == K
        same = norm == c[:, None]
        best = np.where((table("loose")[c] > 0)[:, None], (cost[i - 1, :, 1:] + 1) * 8 + D, FAR * 8)
        best = np.minimum(best, np.where(same, diagonal * 8 + K, FAR * 8))
        changes = [(S, table("small")[c][:, None] == norm)]
        if i == 1:
            changes.append((V, (table("voiced")[c][:, None] == norm) & (np.arange(m) == 0)))
        else:
            before, marks = surf[:, i - 2], (table("mark")[c] > 0)[:, None] & kept
            changes += [(P, marks & (table("vowel")[before][:, None] == norm)), (E, marks & (table("e")[before][:, None] == norm))]
        for letter, fits in changes:
            best = np.minimum(best, np.where(fits & ~same, (diagonal + 1) * 8 + letter, FAR * 8))
        reached = best < FAR * 8
        cost[i, :, 1:] = np.where(reached, best >> 3, FAR)
        op[i, :, 1:] = np.where(reached, best & 7, -1)
    rows = np.arange(len(surfs))
    known = cost[lengths, rows, targets] < FAR
    out = np.full((len(surfs), n), -1, np.int8)
    at, j = lengths.copy(), targets.copy()
    live = rows[known & (at > 0)]
    while len(live):
        letter = op[at[live], live, j[live]]
        out[live, at[live] - 1] = letter
        at[live] -= 1
        j[live] -= letter != D
        live = live[at[live] > 0]
    return [[LETTERS[x] for x in out[k, :size]] if ok else [NORM_IGNORED] * size for k, (size, ok) in enumerate(zip(lengths.tolist(), known.tolist(), strict=True))]


def infer_ops_of(pairs: list[tuple[str, str]]) -> list[list[str] | None]:
    """The operations of each pair as kernels.norm.infer_ops gives them; None where a normal form is empty or longer than its written form.

    Pairs of like length are worked out together, each distinct one once.
    """
    found: dict[tuple[str, str], list[str] | None] = dict.fromkeys(pairs)
    sizes: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for s, n in found:
        if n and len(n) <= len(s):
            sizes.setdefault(((len(s) - 1).bit_length(), (len(n) - 1).bit_length()), []).append((s, n))
    for of in sizes.values():
        step = max(1, CELLS // ((max(len(s) for s, _ in of) + 1) * (max(len(n) for _, n in of) + 1)))
        for k in range(0, len(of), step):
            some = of[k : k + step]
            found.update(zip(some, aligned([s for s, _ in some], [n for _, n in some]), strict=True))
    return [found[p] for p in pairs]
