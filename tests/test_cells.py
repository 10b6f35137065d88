"""The nearest of all vectors by cells and sketches: exact, whatever lies where, and far from all pairs."""

import numpy as np
import pytest

from gradeloom.operators import blocks


def brute(ids, v, k):
    order = np.argsort(ids)
    ids, v = ids[order], v[order].astype(float)
    d = ((v[:, None] - v) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {(int(ids[i]), int(ids[j]), d[i, j]) for i in range(len(v)) for j in np.argsort(d[i], kind="stable")[:k] if np.isfinite(d[i, j])}


def groups(random, n, width):
    """Tight groups, far apart, with copies."""
    v = random.integers(-20000, 20000, (12, width))[random.integers(0, 12, n)] + random.integers(-9, 9, (n, width))
    v[: n // 10] = v[0]
    return v


@pytest.mark.parametrize("rows, cell, lines", [(16384, 8192, 64), (40, 30, 3), (25, 1000, 1)])
def test_nearest_of_all_are_exact(spark, monkeypatch, rows, cell, lines):
    for name, value in {"ROWS": rows, "CELL": cell, "LINES": lines, "SAMPLE": 100, "STEP": 64}.items():
        monkeypatch.setattr(blocks, name, value)
    random = np.random.default_rng(3)
    for v in (groups(random, 400, 6), random.integers(0, 3, (300, 5)), np.zeros((90, 4), int), random.integers(0, 9, (3, 2))):
        ids = random.permutation(len(v)) * 7
        frame = spark.createDataFrame([(int(i), int(i) % 5, [int(c) for c in x]) for i, x in zip(ids, v, strict=True)] + [(-1, 0, None), (-2, 0, [1] * (v.shape[1] - 1) + [None])], "id long, label int, v array<int>")
        got = blocks.nearest(frame, 3).collect()
        assert {(r.id, r.known_id, r.far) for r in got} == brute(ids, v, 3) and len(got) == len(v) * min(3, len(v) - 1)
        assert all(r.label == r.known_id % 5 for r in got)


def test_few_cells_are_asked():
    random = np.random.default_rng(4)
    v = groups(random, 3000, 40)
    cells = blocks._Cells(v[:500].astype(float), 50)
    y = cells.sketch(v)
    d = cells.to_centres(y)
    reach = np.full(len(cells.centres), -np.inf)
    np.maximum.at(reach, d.argmin(axis=1), d.min(axis=1))
    assert cells.asked(y, np.full(len(v), 60.0), reach).mean() < 0.3
    gap = ((v[:50, None] - v) ** 2).sum(axis=2)
    assert (((y[:50, None] - y) ** 2).sum(axis=2) <= gap * (1 + 1e-9) + 1e-3).all()
