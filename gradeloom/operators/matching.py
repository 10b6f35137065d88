"""Sequential operators on small groups (J14, W8), models and plug-ins."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from gradeloom.session import dealt


#: Distances that are looked at at once.
AT_ONCE = 1 << 20


def _near_places(e: np.ndarray, o: np.ndarray, low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places whose distance is above low and at most high. o is in order of x."""
    first, last = np.searchsorted(o[:, 0], e[:, 0] - high, "left"), np.searchsorted(o[:, 0], e[:, 0] + high, "right")
    ends = np.cumsum(last - first)
    at = 0
    while at < len(e):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        many = (last - first)[at:stop]
        i = np.repeat(np.arange(at, stop), many)
        j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at:stop], many)
        d = np.hypot(e[i, 0] - o[j, 0], e[i, 1] - o[j, 1])
        near = (d > low) & (d <= high)
        yield d[near], i[near], j[near]
        at = stop


def greedy_pairs(e: np.ndarray, o: np.ndarray, reach: float) -> list[tuple[int, int, float]]:
    """Pairs by ascending distance (ties: the first of e, then of o), each point used once, none beyond the reach.

    Points of one place are one with a queue, and places meet by bands of distance, so what is held are the near
    pairs of places that still have points. A band with too many of them is halved.
    """
    if not len(e) or not len(o):
        return []
    out: list[tuple[int, int, float]] = []
    places, queues = [], []
    for points in (e, o):
        place, of = np.unique(np.asarray(points, dtype=float), axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        # the last of a queue is its first point
        queues.append([q[::-1].tolist() for q in np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1])])
        places.append(place)
    left, right = queues
    low, width = -1.0, reach / 64
    while low < reach:
        high = 0.0 if low < 0 else min(reach, low + width)
        a, b = (np.array([k for k, q in enumerate(qs) if q], dtype=int) for qs in queues)
        if not len(a) or not len(b):
            break
        found, held = [], 0
        for part in _near_places(places[0][a], places[1][b], low, high):
            found.append(part)
            held += len(part[0])
            if held > AT_ONCE and high - low > 1e-9 * (1 + reach) and low >= 0:
                break
        else:
            d, i, j = (np.concatenate([f[c] for f in found]) for c in range(3))
            order = np.argsort(d, kind="stable")
            d, i, j = d[order], a[i[order]], b[j[order]]
            cuts = np.append(np.flatnonzero(np.diff(d, prepend=-1.0)), len(d))
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                _level(left, right, i[start:stop].tolist(), j[start:stop].tolist(), float(d[start]), out)
            low, width = high, width * 2 if held < AT_ONCE // 4 else width
            continue
        width /= 2
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def _level(left: list[list[int]], right: list[list[int]], i: list[int], j: list[int], d: float, out: list[tuple[int, int, float]]) -> None:
    """Takes the pairs of one distance: points of e in their order, each with the first free point of o."""
    to: dict[int, list[int]] = {}
    for p, q in zip(i, j):
        if left[p] and right[q]:
            to.setdefault(p, []).append(q)
    heads = [(left[p][-1], p) for p in to]
    heapq.heapify(heads)
    while heads:
        point, p = heads[0]
        free = [q for q in to[p] if right[q]]
        if not free:
            heapq.heappop(heads)
            continue
        to[p] = free
        q = min(free, key=lambda q: right[q][-1])
        out.append((point, right[q].pop(), d))
        left[p].pop()
        if left[p]:
            heapq.heapreplace(heads, (left[p][-1], p))
        else:
            heapq.heappop(heads)


def nearest_matches(expected: DataFrame, observed: DataFrame, reach: float) -> DataFrame:
    """On each page, pairs by ascending distance, each point used once. A task holds a page's points, not their pairs."""
    a = expected.select("page", F.col("id"), "x", "y", F.lit(0).alias("side"))
    both = a.unionByName(observed.select("page", "id", "x", "y", F.lit(1).alias("side")))

    def match(part: pd.DataFrame) -> pd.DataFrame:
        e, o = part[part.side == 0].sort_values("id"), part[part.side == 1].sort_values("id")
        found = greedy_pairs(e[["x", "y"]].to_numpy(), o[["x", "y"]].to_numpy(), reach)
        rows = [(part.page.iloc[0], e.id.iloc[i], o.id.iloc[j], d) for i, j, d in found]
        return pd.DataFrame(rows, columns=["page", "expected", "observed", "distance"])

    # few bytes, much work: pages go to tasks of their own
    return dealt(both, "page", each=4096).groupBy("page").applyInPandas(match, "page long, expected long, observed long, distance double")


def regular_run(points: DataFrame, count: int, pitch: float, gap: float) -> DataFrame:
    """Centres are clustered by gaps with a running mean; the window of count centres of the most regular pitch."""

    def best(part: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[float]] = []
        for v in np.sort(part["at"].to_numpy()):
            if groups and v - np.mean(groups[-1]) <= gap:
                groups[-1].append(v)
            else:
                groups.append([v])
        centres = np.array([np.mean(g) for g in groups])
        runs = [(float(np.abs(np.diff(centres[i : i + count]) - pitch).sum()), i) for i in range(len(centres) - count + 1)]
        if not runs:
            return pd.DataFrame({"page": [], "first": [], "error": []})
        error, i = min(runs)
        return pd.DataFrame({"page": [part.page.iloc[0]], "first": [float(centres[i])], "error": [error]})

    return points.groupBy("page").applyInPandas(best, "page long, first double, error double")


def _weighted(rows: DataFrame, label: str, classes: int | None = None) -> DataFrame:
    """The labelled rows with weights that make their labels count alike.

    A classifier's labels are few, so their numbers are constants: a join by label would bring all rows of one into one task.
    """
    counts = rows.groupBy(label).count().collect()
    total, classes = sum(r["count"] for r in counts), classes or len(counts)
    weight = F.lit(None).cast("double")
    for r in counts:
        weight = F.when(F.col(label) == F.lit(r[label]), total / (classes * r["count"])).otherwise(weight)
    return rows.where(F.col(label).isNotNull()).withColumn("weight", weight)


def crop_classifier(rows: DataFrame, features: list[str], label: str):
    """M5: standardised logistic regression with balanced weights; the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    weighted = _weighted(rows, label, 2)
    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)]
    return Pipeline(stages=steps).fit(weighted)


def crop_forest(rows: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 8, leaf: int = 3, seed: int = 557):
    """M5: a random forest with balanced weights; the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    weighted = _weighted(rows, label)
    forest = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(weighted)


_backends: dict[str, Callable[[], Callable[[list[bytes]], list[tuple[str, float]]]]] = {}


def register_reader(name: str, make: Callable) -> None:
    """A reader by name; make() gives a function from crops to (text, confidence)."""
    _backends[name] = make


def read_with(name: str, crop: Column) -> Column:
    """Text and confidence of crops by a registered reader, a batch at a time."""
    make = _backends[name]

    @F.pandas_udf("struct<text:string,confidence:double>")
    def read(crops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(make()(crops.tolist()), columns=["text", "confidence"])

    return read(crop)


@udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("digit", T.IntegerType()), T.StructField("cx_mm", T.DoubleType()), T.StructField("cy_mm", T.DoubleType())]))
class DigitGrid:
    """The centres of a digit grid, as a table function."""

    def eval(self, positions: int, x_mm: float, y_mm: float, digit_pitch: float, position_pitch: float):
        for place in range(positions):
            for digit in range(10):
                yield place, digit, x_mm + place * position_pitch, y_mm + digit * digit_pitch
