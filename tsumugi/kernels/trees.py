"""Dependency trees built greedily from ranked heads."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

ROOT = -1


def has_cycle(heads: dict[int, int]) -> bool:
    """Whether following heads ever comes back; -1 is the root."""
    done: set[int] = set()
    for start in heads:
        path, at = set(), start
        while at in heads and at not in done:
            if at in path:
                return True
            path.add(at)
            at = heads[at]
        done |= path
    return False


class Arc(NamedTuple):
    head: int
    kind: str


def build_tree(ranked: Sequence[Sequence[tuple[int, str]]]) -> list[Arc]:
    """The head of each unit, from left to right: its best candidate that makes neither a cycle nor a second root.

    Without one, the last unit becomes the root if there is none yet; else the nearest unit to the right, then to the
    left, that makes no cycle is the head, with kind D.
    """
    n, heads, out = len(ranked), {}, []
    rooted = False

    def fits(unit: int, head: int) -> bool:
        if head == ROOT:
            return not rooted
        at: int | None = head  # heads so far are a forest: only a path from head to unit closes a cycle
        while at is not None and at != ROOT:
            if at == unit:
                return False
            at = heads.get(at)
        return True

    for unit, options in enumerate(ranked):
        arc = next((Arc(h, k) for h, k in options if fits(unit, h)), None)
        if arc is None:
            if unit == n - 1 and not rooted:
                arc = Arc(ROOT, "D")
            else:
                near = [*range(unit + 1, n), *range(unit - 1, -1, -1)]
                head = next((h for h in near if fits(unit, h)), None)
                if head is None:
                    raise ValueError("no head without a cycle")
                arc = Arc(head, "D")
        heads[unit] = arc.head
        rooted = rooted or arc.head == ROOT
        out.append(arc)
    return out


def phrase_heads(tree: Sequence[Arc], phrase_of: Sequence[int]) -> dict[int, Arc]:
    """The head phrase of each phrase: that of its last unit whose head lies in another phrase (or is the root)."""
    out: dict[int, Arc] = {}
    for unit, arc in enumerate(tree):
        if arc.head == ROOT:
            out[phrase_of[unit]] = Arc(ROOT, "D")
        elif phrase_of[arc.head] != phrase_of[unit]:
            out[phrase_of[unit]] = Arc(phrase_of[arc.head], arc.kind)
    return out
