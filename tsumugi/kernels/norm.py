"""Word normalization: operations that turn a written form into its normal form, inferred, applied and reversed."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from tsumugi.vocab import BEFORE_E, BEFORE_I, BEFORE_U, GEMINATES, LARGE_TO_SMALL, NORM_IGNORED, PROLONGED_E, PROLONGED_MARKS, PROLONGED_VOWEL, SMALL_TO_LARGE, VOICED_TO_VOICELESS

INFINITE = float("inf")


def removable(c: str) -> bool:
    return c in PROLONGED_MARKS or c in GEMINATES or c in SMALL_TO_LARGE


def infer_ops(surf: str, norm: str) -> list[str]:
    """The cheapest operations from surf to norm, one a character: keep costs 0, all others 1, ties go to the lesser letter.

    Raises ValueError if norm is empty or longer than surf. If no operations lead there, every character is marked "_".
    """
    if not norm or len(norm) > len(surf):
        raise ValueError(f"no operations from {surf!r} to {norm!r}")
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    unreachable = (INFINITE, NORM_IGNORED)
    for j, target in enumerate(norm, 1):
        for i in range(j, len(surf) + 1):
            c, diagonal = surf[i - 1], best.get((i - 1, j - 1), unreachable)
            options = []
            if removable(c):
                options.append((best.get((i - 1, j), unreachable)[0] + 1, "D"))
            if c == target:
                options.append((diagonal[0], "K"))
            else:
                before = surf[i - 2] if i > 1 and c in PROLONGED_MARKS and diagonal[1] == "K" else ""
                changes = (
                    ("V", i == j == 1 and VOICED_TO_VOICELESS.get(c) == target),
                    ("S", SMALL_TO_LARGE.get(c) == target),
                    ("P", bool(before) and PROLONGED_VOWEL.get(before) == target),
                    ("E", bool(before) and PROLONGED_E.get(before) == target),
                )
                options.extend((diagonal[0] + 1, op) for op, fits in changes if fits)
            if options:
                best[i, j] = min(options)
    i, j = len(surf), len(norm)
    if best.get((i, j), unreachable)[0] == INFINITE:
        return [NORM_IGNORED] * len(surf)
    ops = []
    while (i, j) != (0, 0):
        op = best[i, j][1]
        ops.append(op)
        i, j = i - 1, j - (op != "D")
    return ops[::-1]


def apply_op(out: str, c: str, op: str, first: bool) -> tuple[str, str | None]:
    """What a character adds to the output so far, and why the operation doesn't fit it, if so (the character then stays)."""
    if op == "K":
        return c, None
    if op == "D":
        return "", None if removable(c) else f"{c} isn't removable"
    if op == "V":
        return VOICED_TO_VOICELESS.get(c, c), f"{c} isn't an initial voiced kana" if not first or c not in VOICED_TO_VOICELESS else None
    if op == "S":
        return SMALL_TO_LARGE.get(c, c), None if c in SMALL_TO_LARGE else f"{c} isn't a small kana"
    if op in "PE":
        vowels = PROLONGED_VOWEL if op == "P" else PROLONGED_E
        if not out or c not in PROLONGED_MARKS or out[-1] not in vowels:
            return c, f"{c} doesn't prolong {out[-1:]!r}"
        return vowels[out[-1]], None
    raise NotImplementedError(f"unknown operation {op!r}")


def apply_ops(surf: str, ops: Sequence[str], strict: bool = True) -> str:
    """surf under its operations. What doesn't fit raises ValueError if strict, else leaves the character as it is."""
    if len(surf) != len(ops):
        raise ValueError("one operation a character is needed")
    out = ""
    for i, (c, op) in enumerate(zip(surf, ops, strict=True)):
        added, wrong = apply_op(out, c, op, i == 0)
        if wrong and strict:
            raise ValueError(f"{wrong} in {surf}")
        out += added
    return out


def is_kana(c: str) -> bool:
    return "぀" <= c <= "ヿ"


def is_kanji(c: str) -> bool:
    return "一" <= c <= "鿿"


def kanji_ga(surf: str) -> int:
    """The place of an inner ケ (or, without one, ヶ) between two kanji, else -1."""
    inner = surf[1:-1]
    at = next((inner.find(c) + 1 for c in "ケヶ" if c in inner), 0)
    return at if at and is_kanji(surf[at - 1]) and is_kanji(surf[at + 1]) else -1


def denormalize(surf: str, mark: str = "ー") -> str:
    """A common variant spelling: a small last kana, ケ/ヶ exchanged, or the last prolongable vowel as a mark."""
    if surf[-1] in LARGE_TO_SMALL:
        return surf[:-1] + LARGE_TO_SMALL[surf[-1]]
    at = kanji_ga(surf)
    if at >= 0:
        return surf[:at] + SMALL_TO_LARGE[surf[at]] + surf[at + 1 :]
    before = {"う": BEFORE_U, "い": BEFORE_I, "え": BEFORE_E}
    for i in range(len(surf) - 1, 0, -1):
        if surf[i - 1] in before.get(surf[i], ()):
            return surf[:i] + mark + surf[i + 1 :]
    return surf


#: Last kana by the small vowel that may follow, and the weights of what may be appended (fixed values).
SMALL_AFTER = {"ぁ": "あかさたなはまやらわがざだばぱゃ", "ぅ": "うくすつぬふむゆるぐずづぶぷゅ", "ぉ": "おこそとのほもよろごぞどぼぽょ"}
SMALL_WEIGHTS = {"ぁ": (0.5, 0.05, 0.025), "ぅ": (0.5, 0.005, 0.025), "ぉ": (0.5, 0.05, 0.025)}
ENDINGS = (("ー", 1.0), ("ーー", 0.1), ("ーーー", 0.05), ("〜", 0.2), ("〜〜", 0.02), ("〜〜〜", 0.001), ("っ", 0.1), ("ッ", 0.05))


def variants(surf: str, plain: str) -> list[tuple[str, float]]:
    """Spellings of surf with their weights; plain is its deterministic variant."""
    out = [(surf, 10.0)]
    last, rest = plain[-1], plain[:-1]
    if is_kana(last):
        scale = 0.01 if last in "んンっッ" else 0.1
        out += [(plain + e, scale * w) for e, w in ENDINGS]
    small = next((s for s, kana in SMALL_AFTER.items() if last in kana), None)
    if small:
        out += [(plain + small + "ー" * k, w) for k, w in enumerate(SMALL_WEIGHTS[small])]
    elif last == "っ":
        out += [(plain + "っ", 0.5), (plain + "っっ", 0.05), (plain + "っっ", 0.025)]
    if last in "いく" and rest and is_kana(rest[-1]) and not (small and last == "い"):
        if last == "い" or not small:
            out += [(rest + "ー" + last, 1.0), (rest + "ーー" + last, 0.1)]
    if plain in ("です", "ます"):
        out += [(plain[0] + "ーす", 1.0), (plain[0] + "〜す", 0.2)]
    return out


def denormalize_randomly(surf: str, rng: random.Random) -> str:
    """One of the variants, drawn by weight; words of one character stay."""
    if len(surf) <= 1:
        return surf
    plain = denormalize(surf, "〜" if rng.random() < 0.1 else "ー")
    options = variants(surf, plain)
    if len(options) == 1:
        return plain
    words, weights = zip(*options, strict=True)
    return rng.choices(words, weights)[0]


def denormalize_sentence(words: Sequence[tuple[str, str]], rng: random.Random, p: float = 0.5, vary: Callable[[str, random.Random], str] = denormalize_randomly) -> list[str]:
    """words: (written, normal form). From the right, words that are normal become variants with a probability of p.

    After each change the probability falls to a tenth; after a word without a variant it rises by half, up to p.
    """
    out, now = [w for w, _ in words], p
    for i in range(len(words) - 1, -1, -1):
        surf, norm = words[i]
        try:
            normal = set(infer_ops(surf, norm)) == {"K"}
        except ValueError:
            normal = False
        if not normal:
            continue
        other = vary(surf, rng)
        if other == surf:
            now = min(1.5 * now, p)
        elif rng.random() < now:
            out[i], now = other, now * 0.1
    return out
