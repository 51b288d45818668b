"""The best of many scores within one task, in a memory that the number of questions bounds and not the rows seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Scores that are looked at together; a block of rows has so many of them at most, over all questions.
CELLS = 1_000_000


class Best:
    """Keeps `top` (id, score) of each of `count` questions: the greatest scores, rounded to nine places, of equal ones the greater ids.

    Candidates are collected and cut to the best when they are several times what is kept. ids are any
    numpy array that can be sorted. exact=False leaves scores as they are, for those compared again anyway.
    """

    def __init__(self, count: int, top: int, exact: bool = True) -> None:
        self.count, self.top, self.exact = count, top, exact
        self.least = np.full(count, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def blocks(self, rows: int) -> Iterator[slice]:
        """Slices of so many rows that their scores for all questions are few."""
        size = max(1, CELLS // max(1, self.count))
        return (slice(i, min(rows, i + size)) for i in range(0, rows, size))

    def add(self, ids: np.ndarray, scores: np.ndarray, above: float | None = None) -> None:
        """scores (rows, questions) of rows of these ids; with above, only greater ones count."""
        good = scores >= self.least - 1e-9
        if above is not None:
            good &= scores > above
        row, q = np.nonzero(good)
        self.put(ids[row], q, scores[row, q], above)

    def put(self, ids: np.ndarray, q: np.ndarray, scores: np.ndarray, above: float | None = None) -> None:
        """Scores one by one."""
        if self.exact:
            scores = np.round(scores, 9)
        good = scores >= self.least[q]
        if above is not None:
            good &= scores > above
        if good.any():
            self.parts.append((ids[good], q[good], scores[good]))
            self.held += int(good.sum())
            if self.held > max(4 * self.count * self.top, CELLS // 4):
                self._cut()

    def _cut(self) -> None:
        ids, q, scores = (np.concatenate(c) for c in zip(*self.parts))
        code = ids if ids.dtype.kind == "i" else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((-code, -scores, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, last = order[place < self.top], order[place == self.top - 1]
        self.parts, self.held = [(ids[order], q[place < self.top], scores[order])], len(order)
        self.least[q[place == self.top - 1]] = scores[last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, questions, scores), questions by number; none if there was nothing."""
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]
