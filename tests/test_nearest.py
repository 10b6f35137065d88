"""Greedy pairs of a page without a matrix of all of them."""

import tracemalloc

import numpy as np

from gradeloom.operators import matching as M


def all_pairs(e, o, reach):
    far = np.hypot(e[:, 0][:, None] - o[:, 0], e[:, 1][:, None] - o[:, 1])
    out, left, right = [], set(), set()
    for k in np.argsort(far, axis=None, kind="stable"):
        i, j = divmod(int(k), far.shape[1])
        if far[i, j] > reach:
            break
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j, float(far[i, j])))
    return out


def test_pairs_are_those_of_the_whole_order():
    r = np.random.default_rng(4)
    for n, m, most in ((60, 50, 8), (200, 200, 12), (1, 7, 3), (0, 5, 3), (5, 0, 3), (150, 90, 1000)):
        e, o = (r.integers(0, most, (k, 2)).astype(float) for k in (n, m))
        for reach in (0.0, 2.5, 40.0):
            assert M.greedy_pairs(e, o, reach) == all_pairs(e, o, reach)


def test_memory_grows_with_points_not_with_pairs():
    k = np.arange(12000)
    points = np.column_stack([k * 37 % 200, k * 53 % 280]).astype(float)
    tracemalloc.start()
    found = M.greedy_pairs(points[::2], points[1::2], 40.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 5900 and peak < 150e6  # a matrix of all distances has 288 MB


def test_points_of_one_place_are_looked_at_as_one(monkeypatch):
    k = np.arange(6000)
    points = np.column_stack([k % 10, k % 7]).astype(float)
    seen, real = [0], np.hypot
    monkeypatch.setattr(np, "hypot", lambda a, b: seen.__setitem__(0, seen[0] + np.size(a)) or real(a, b))
    found = M.greedy_pairs(points[::2], points[1::2], 40.0)
    # all pairs are nine million
    assert len(found) == 3000 and seen[0] < 100_000


def test_bands_with_many_pairs_are_halved(monkeypatch):
    r = np.random.default_rng(8)
    e, o = r.random((120, 2)) * 50, r.random((110, 2)) * 50
    monkeypatch.setattr(M, "AT_ONCE", 16)
    assert M.greedy_pairs(e, o, 40.0) == all_pairs(e, o, 40.0)
