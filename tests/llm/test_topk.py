"""Exact search by inner product against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label long, id string"


def expected(rows, wanted, top=5):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = min(usable.get(i, v), v)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in usable.items()}
    out = []
    for q in filter(wanted, whole):
        near = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)[:top]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def got(df, **more):
    return sorted(map(tuple, topk.search(df, F.col("id") % 50 == 0, **more).collect()))


def made(n, d, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    return [(i, (centres[i % 12] + 0.2 * r.normal(size=d)).tolist(), 0, "x") for i in range(n)]


@pytest.mark.parametrize(("n", "d"), [(1500, 16), (900, 3)])
def test_all_of_the_best_are_found(spark, n, d):
    rows = made(n, d)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, block=64, group=8) == expected(rows, lambda i: i % 50 == 0)


def test_odd_rows(spark):
    rows = made(400, 8)
    same = rows[7][1]
    rows += [(1000 + i, same, 0, "copy") for i in range(300)]  # a hot vector, some of its copies are queries
    rows += [(2000, None, 0, ""), (2050, [None] * 8, 0, ""), (2100, [math.nan] * 8, 0, ""), (2150, [math.inf] * 8, 0, ""), (None, same, 0, "")]
    rows += [(2200, [0.0] * 8, 0, ""), (2250, [], 0, ""), (2300, [9.0, 9.0], 0, ""), (7, [5.0] * 8, 0, "two"), (0, rows[0][1], 0, "again")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, block=50, group=4) == expected(rows, lambda i: i % 50 == 0)


def test_ties_few_and_none(spark):
    ties = [(i, [1.0, 0.0], 0, "") for i in range(0, 500, 3)] + [(i, [1.0, float(i)], 0, "") for i in range(1, 500, 3)]
    assert got(spark.createDataFrame(ties, SCHEMA), block=16) == expected(ties, lambda i: i % 50 == 0)
    few = [(0, [1.0], 0, ""), (1, [-1.0], 0, ""), (2, [-1.0], 0, "")]
    assert got(spark.createDataFrame(few, SCHEMA)) == expected(few, lambda i: i % 50 == 0)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(50, [1.0], 0, "")], SCHEMA)) == []


def test_numbers_beyond_doubles(spark):
    rows = [(i, [3e7 + i, 1e8 - 7 * i, 1.0], 0, "") for i in range(0, 120)] + [(1000, [1e300, 1.0, 1.0], 0, ""), (1001, [-1e300, 1.0, 0.0], 0, "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows, lambda i: i % 50 == 0)


def test_vectors_are_left_out_by_their_bounds():
    r = np.random.default_rng(0)
    centres = 3 * r.normal(size=(6, 12))
    v = np.floor(256 * (centres[np.arange(6000) // 1000] + 0.02 * r.normal(size=(6000, 12))))
    most = float(np.linalg.norm(v, axis=1).max()) * (1 + 1e-9)
    points = np.concatenate([v / most, np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1) / most**2))[:, None]], axis=1)[::1000]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    space = topk.Space(12, most, points[:, :-1], points[:, -1])
    one = topk.Search(space, np.array([0]), v[:1], 5)
    done = one.block(v, space.of_vectors(v), np.arange(6001), np.arange(6000), np.array([0]))
    score = v @ v[0]
    score[0] = -np.inf
    assert one.ids[0].tolist() == np.lexsort((np.arange(6000), -score))[:5].tolist()
    assert done <= 2000


def test_query(spark, sf):
    out = entry.queries()["op12_topk"](spark, sf)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, out.collect())) == expected(rows, lambda i: i % 50 == 0)
