"""Lists of numbers in flat arrays, and the best scores of many lists at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of a list column."""
    return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0), np.int64))


@dataclass(frozen=True)
class Lists:
    """List ``k`` is ``values[start[k] : start[k + 1]]``."""

    start: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, lists: Sequence[Sequence[int]]) -> Lists:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for values in lists for x in values), np.int64, int(sizes.sum()))
        return cls(np.concatenate(([0], np.cumsum(sizes))), flat)

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        return self.start[keys + 1] - self.start[keys]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where in ``values`` the lists of ``keys`` are, one after the other."""
        sizes = self.sizes(keys)
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[keys] - (ends - sizes), sizes)

    def expand(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``keys`` one after the other: the place of each value's key, and the value."""
        return np.repeat(np.arange(len(keys)), self.sizes(keys)), self.values[self.places(keys)]


class Best:
    """The best ``n`` scores, rounded to nine digits, of each of ``size`` lists; ties go to the smaller unit."""

    def __init__(self, size: int, n: int):
        self.size, self.n = size, n
        self.least = np.full(size, -np.inf)
        self.list_, self.unit, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def may_enter(self, scores: np.ndarray) -> np.ndarray:
        """Of scores with a column for each list those that are not beaten yet."""
        return scores >= self.least - 1e-9

    def put(self, list_: np.ndarray, unit: np.ndarray, score: np.ndarray) -> None:
        if not len(list_):
            return
        list_, unit, score = (np.concatenate(x) for x in ((self.list_, list_), (self.unit, unit), (self.score, score)))
        rounded = np.round(score, 9)
        order = np.lexsort((unit, -rounded, list_))
        first = np.searchsorted(list_[order], np.arange(self.size + 1))
        place = np.arange(len(order)) - first[list_[order]]
        order = order[place < self.n]
        self.list_, self.unit, self.score = list_[order], unit[order], score[order]
        full = np.flatnonzero(np.diff(first) >= self.n)
        last = np.searchsorted(self.list_, full, "right") - 1
        self.least[full] = np.round(self.score[last], 9)
