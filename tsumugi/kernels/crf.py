"""A linear-chain conditional random field over BIO tags: constraints, decoding, likelihood."""

from __future__ import annotations

import numpy as np

from tsumugi.vocab import MASKED


class Chain:
    """start, end and step scores; what BIO forbids has the masked score."""

    def __init__(self, tags: tuple[str, ...], start: np.ndarray | None = None, step: np.ndarray | None = None, end: np.ndarray | None = None):
        n = len(tags)
        self.tags = tags
        self.start = np.zeros(n) if start is None else np.array(start, float)
        self.step = np.zeros((n, n)) if step is None else np.array(step, float)
        self.end = np.zeros(n) if end is None else np.array(end, float)
        inside = np.array([t.startswith("I-") for t in tags])
        kind = np.array([t[2:] for t in tags])
        self.start[inside] = MASKED
        follows = (kind[:, None] == kind[None, :]) & np.array([t != "O" for t in tags])[:, None]
        self.step[:, inside] = np.where(follows[:, inside], self.step[:, inside], MASKED)

    def _path(self, emissions: np.ndarray, mask: np.ndarray) -> tuple[int, int, list[int]]:
        """First and last unmasked step, and the unmasked steps between."""
        at = np.flatnonzero(mask)
        return (int(at[0]), int(at[-1]), at[1:].tolist()) if len(at) else (len(mask), -1, [])

    def decode(self, emissions: np.ndarray, mask: np.ndarray) -> list[int]:
        """The best tags, O outside the unmasked span; a masked step within it repeats the choice before it."""
        outside = self.tags.index("O")
        first, last, _ = self._path(emissions, mask)
        if last < 0:
            return [outside] * len(mask)
        score, back = self.start + emissions[first], []
        for j in range(first + 1, last + 1):
            if not mask[j]:
                back.append(np.arange(len(self.tags)))
                continue
            options = score[:, None] + self.step + emissions[j][None, :]
            back.append(options.argmax(axis=0))
            score = options.max(axis=0)
        best = [int((score + self.end).argmax())]
        for pointers in reversed(back):
            best.append(int(pointers[best[-1]]))
        return [outside] * first + best[::-1] + [outside] * (len(mask) - last - 1)

    def log_likelihood(self, emissions: np.ndarray, tags: list[int], mask: np.ndarray) -> float:
        """log p(tags); 0 if all is masked."""
        first, last, rest = self._path(emissions, mask)
        if last < 0:
            return 0.0
        own, score = self.start[tags[first]] + emissions[first, tags[first]], self.start + emissions[first]
        for j in rest:
            own += self.step[tags[j - 1], tags[j]] + emissions[j, tags[j]]
            options = score[:, None] + self.step
            top = options.max(axis=0)
            score = top + np.log(np.exp(options - top).sum(axis=0)) + emissions[j]
        own, score = own + self.end[tags[last]], score + self.end
        return float(own - (score.max() + np.log(np.exp(score - score.max()).sum())))


def reduce_losses(losses: list[float], sizes: list[int], how: str = "token_mean") -> float:
    """Losses of sequences of the given sizes as one: token_mean, mean or sum."""
    if how == "sum":
        return sum(losses)
    if how == "mean":
        return sum(losses) / len(losses) if losses else float("nan")
    if how == "token_mean":
        each = [x / (n + 1e-6) for x, n in zip(losses, sizes, strict=True)]
        return sum(each) / (sum(n > 0 for n in sizes) + 1e-6)
    raise ValueError(f"unknown reduction {how!r}")
