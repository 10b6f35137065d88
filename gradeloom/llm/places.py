"""Token ids of strings met before, in flat arrays: a string has a place, its ids are taken from there.

A task looks up each word of a text once in a dict, which gives a number; the ids of a whole
batch of texts are then one numpy gather.
"""

from __future__ import annotations

from itertools import compress

import numpy as np


class Grown:
    """A numpy array that grows as it is filled."""

    def __init__(self, kind: str, size: int = 1 << 16):
        self.data, self.n = np.zeros(size, dtype=kind), 0

    def reserve(self, n: int) -> None:
        if n > len(self.data):
            more = np.zeros(max(n, 2 * len(self.data)), dtype=self.data.dtype)
            more[: len(self.data)] = self.data
            self.data = more

    def extend(self, values) -> None:
        self.reserve(self.n + len(values))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... so many each."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Store:
    """Ids by place. n: places given out."""

    def __init__(self) -> None:
        self.n = 0
        self.flat, self.first, self.size = Grown("i4"), Grown("i8"), Grown("i4")

    def full(self, places: int, ids: int) -> bool:
        return self.n > places or self.flat.n > ids

    def put(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """So many of the ids for each of the places."""
        self.first.reserve(self.n)
        self.size.reserve(self.n)
        self.first.data[places] = self.flat.n + np.cumsum(sizes) - sizes
        self.size.data[places] = sizes
        self.flat.extend(ids)

    def take(self, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the places, one after the other, and where each list's begin whose places begin at ends."""
        size = self.size.data[places]
        ids = self.flat.data[spread(self.first.data[places], size)]
        return ids, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends]

    def take_lists(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        return self.take(every, np.cumsum([0, *map(len, places)]))


class Places(dict):
    """Places of strings; one that is new gets the next place and is listed as fresh."""

    def __init__(self, store: Store):
        super().__init__()
        self.store = store
        self.fresh: list[str] = []

    def __missing__(self, string: str) -> int:
        self[string] = place = self.store.n
        self.store.n = place + 1
        self.fresh.append(string)
        return place

    def of(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, strings), dtype=np.int64, count=len(strings))

    def taken(self) -> tuple[list[str], np.ndarray]:
        """The fresh strings and their places. Those of more than 64 characters are not kept."""
        fresh, self.fresh = self.fresh, []
        places = self.of(fresh)
        for s in compress(fresh, [len(s) > 64 for s in fresh]):
            del self[s]
        return fresh, places
