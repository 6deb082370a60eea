"""Edit scripts between texts: opcodes, character diffs, and the tags of typo correction."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple


class Op(NamedTuple):
    kind: str  # equal, replace, delete or insert
    a1: int
    a2: int
    b1: int
    b2: int


def opcodes(a: str, b: str) -> list[Op]:
    """A minimal edit script (Levenshtein) as runs of one kind; a replace keeps the length.

    Of minimal scripts the one that, read from the end, prefers to keep, then to delete, to insert, and to replace.
    """
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        last, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        rows.append(row)
    steps, i, j = [], len(a), len(b)
    while i or j:
        here = rows[i][j]
        if i and j and a[i - 1] == b[j - 1] and here == rows[i - 1][j - 1]:
            i, j, kind = i - 1, j - 1, "equal"
        elif i and here == rows[i - 1][j] + 1:
            i, kind = i - 1, "delete"
        elif j and here == rows[i][j - 1] + 1:
            j, kind = j - 1, "insert"
        else:
            i, j, kind = i - 1, j - 1, "replace"
        steps.append((kind, i, j))
    out: list[Op] = []
    for kind, i, j in reversed(steps):
        da, db = kind != "insert", kind != "delete"
        if out and out[-1].kind == kind:
            out[-1] = out[-1]._replace(a2=i + da, b2=j + db)
        else:
            out.append(Op(kind, i, i + da, j, j + db))
    return out


def char_diffs(a: str, b: str) -> list[tuple[str, str]]:
    """(before, after) of every changed character; an empty string where one is missing."""
    out = []
    for op in opcodes(a, b):
        if op.kind == "delete":
            out += [(c, "") for c in a[op.a1 : op.a2]]
        elif op.kind == "insert":
            out += [("", c) for c in b[op.b1 : op.b2]]
        elif op.kind == "replace":
            out += zip(a[op.a1 : op.a2], b[op.b1 : op.b2], strict=True)
    return out


def diff_counts(before: str, predicted: str, gold: str) -> tuple[int, int, int]:
    """True positives, false positives and false negatives of the predicted diffs, as multisets."""
    own, right = Counter(char_diffs(before, predicted)), Counter(char_diffs(before, gold))
    both = sum((own & right).values())
    return both, sum(own.values()) - both, sum(right.values()) - both


class Part(NamedTuple):
    before: str
    after: str
    kind: str  # equal, insert, delete or replace


def decompose(before: str, after: str, diffs: list[tuple[str, str]]) -> list[Part] | None:
    """The texts as parts that are equal or one of the diffs, in order; None if they differ elsewhere too."""
    out: list[Part] = []
    for a, b in diffs:
        kind = "insert" if not a else "delete" if not b else "replace"
        wanted, text, other, replacement = (b, after, before, a) if kind == "insert" else (a, before, after, b)
        for found in re.finditer(re.escape(wanted), text):
            at = found.start()
            if text[:at] != other[:at]:
                return None
            rest, other_rest = text[at + len(wanted) :], other[at + len(replacement) :]
            if other[at : at + len(replacement)] == replacement and rest[:1] == other_rest[:1]:
                out += [Part(text[:at], text[:at], "equal"), Part(a, b, kind)]
                before, after = before[at + len(a) :], after[at + len(b) :]
                break
    if before and after:
        if before != after:
            return None
        out.append(Part(before, after, "equal"))
    return out


def tags_of(parts: list[Part], length: int) -> tuple[list[str], list[str]]:
    """Keep/delete/replace and insert tags, length of each (the text's length and one more for the end)."""
    keep, insert = ["K"] * length, ["_"] * length
    at = 0
    for p in parts:
        if p.kind != "equal":
            script = [Op(p.kind, 0, len(p.before), 0, len(p.after))] if p.kind != "replace" else opcodes(p.before, p.after)
            for op in script:
                if op.kind == "delete":
                    keep[at + op.a1 : at + op.a2] = ["D"] * (op.a2 - op.a1)
                elif op.kind == "insert":
                    insert[at + op.a1] = f"I:{p.after[op.b1 : op.b2]}"
                elif op.kind == "replace":
                    keep[at + op.a1 : at + op.a2] = [f"R:{c}" for c in p.after[op.b1 : op.b2]]
        at += len(p.before)
    return keep, insert
