"""Windows over a sequence of items of given lengths."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate


def split_spans(lengths: list[int], max_length: int, stride: int = -1) -> list[tuple[int, int]]:
    """(start, end) of windows that cover the items, each of at most max_length unless a single item exceeds it.

    stride -1: windows don't overlap and are packed greedily. Else each window's end is stride items after the one
    before, and it starts as early as it can; where that isn't possible, the best window by stride, then length.
    """
    total = [0, *accumulate(lengths)]
    n = len(lengths)

    def furthest(start: int, least: int) -> int:
        """The last end from least on for which the window from start isn't too long (least if there is none)."""
        return max(least, bisect_right(total, total[start] + max_length, least, n + 1) - 1)

    out: list[tuple[int, int]] = []
    start = end = 0
    while end < n:
        if stride == -1:
            start, end = end, furthest(end, end + 1)
            out.append((start, end))
            continue
        rejected = []
        for s in range(start, min(end, n - 1) + 1):
            e = furthest(s, end + 1)
            size = total[e] - total[s]
            if size <= max_length and e - end >= stride:
                chosen = (s, end + stride if end else e)
                break
            rejected.append((size <= max_length and e - end == stride, size if size <= max_length else -size, s, e))
        else:
            fits = lambda r: (max_length + 1) * r[0] + r[1]
            chosen = max(rejected, key=fits)[2:]
        start, end = chosen
        out.append((start, end))
    return out
