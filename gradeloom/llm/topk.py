"""Operator 12: exact top-k by inner product, by elimination with a pivot table.

Each component x counts as floor(256 * x). The largest inner product is the nearest point once
all vectors lie on a sphere: a vector v gets a further component sqrt(M^2 - |v|^2), where M is the
greatest norm, and a query is stretched to norm M with 0 there. A bounded sample gives PIVOTS
points that are far from each other. For each vector its distances to all pivots are stored; the
greatest difference to the query's own is a lower bound of their distance, hence an upper
bound of the inner product.

Vectors are sorted by nearest pivot and distance from it (a range sort) and written as blocks of
BLOCK vectors with their pivot table; a directory has each block's least and greatest distance
for every pivot. Queries are sorted alike, so GROUP that follow each other are much alike, and
each such group is searched by one task: it reads the blocks in the order of their bounds, in a
block evaluates the vectors in the order of theirs, and stops for good where no bound reaches
any query's k-th best score. What is skipped is proved to be out; bounds have a margin for rounding.
No candidates are shuffled, nothing but the pivots, M and the folder's name goes through the
driver. A task holds one group, one block and the directory: 8 * PIVOTS bytes for each BLOCK vectors.

Equal vectors are one entry with their k + 1 least ids (copies beyond can't be among a query's k
best), thinned out within each batch before they are shuffled, so that a vector which a third of
all rows share is no hot group. Vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; of rows of one id the vector first in order counts. A shorter
vector's missing components count as 0, also all of an empty one. Ties go to the smaller id.
Scores are exact; one beyond a long is held at the long's bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP, SCALE = 5, 256
PIVOTS, SAMPLE = 32, 4096
BLOCK, GROUP, CHUNK = 4096, 128, 512
#: Vectors whose blocks one task writes.
WRITTEN = 1 << 18
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Share of M by which a bound is loosened: distances are kept as 32-bit floats.
MARGIN = 4e-6


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: the rows that take part, one of each id, components as doubles."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of whole numbers, filled up with zeros."""
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(column), width))
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * np.asarray(column.flatten(), dtype=np.float64)), -1.7e308, 1.7e308)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def entries(rows: DataFrame, top: int) -> DataFrame:
    """key, v, ids: distinct vectors with their top + 1 least ids, ascending."""

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column(0).to_pylist()
            keys = [xxhash.xxh3_128_digest(np.asarray(v, dtype=np.float64).tobytes()) for v in part.column(1).to_numpy(zero_copy_only=False)]
            seen: dict[bytes, list[tuple[int, int]]] = {}
            for i, (k, own) in enumerate(zip(keys, ids, strict=True)):
                seen.setdefault(k, []).append((own, i))
            kept = sorted(i for x in seen.values() for _, i in sorted(x)[: top + 1])
            some = part.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([keys[i] for i in kept], pa.binary())], names=["id", "v", "key"])

    thinned = rows.select("id", "v").mapInArrow(thin, "id long, v array<double>, key binary")
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    first = thinned.withColumn("place", place).where(F.col("place") <= top + 1)
    return first.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


@dataclass
class Space:
    """Pivots on the sphere of radius most; width: components of a vector."""

    width: int
    most: float
    pivots: np.ndarray
    last: np.ndarray

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        """Distances of stored vectors to all pivots."""
        x = v / self.most
        own = (x**2).sum(axis=1)
        last = np.sqrt(np.maximum(0.0, 1.0 - own))
        apart = own[:, None] + last[:, None] ** 2 + 1.0 - 2 * (x @ self.pivots.T + last[:, None] * self.last)
        return np.sqrt(np.maximum(0.0, apart)).astype(np.float32)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(q / self.most, axis=1)
        x = q / self.most / np.where(norm > 0, norm, 1.0)[:, None]
        apart = (x**2).sum(axis=1)[:, None] + 1.0 - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0.0, apart)).astype(np.float32)


def space_of(found: DataFrame, pivots: int, sample: int) -> Space | None:
    """The greatest norm, and pivots far from each other among a sample of the entries of least hash."""
    width = found.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    width = max(width, 1)

    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(matrix(part.column(0), width), axis=1))], names=["norm"])

    some = found.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow()
    x = matrix(some.column(0).combine_chunks(), width)
    largest = found.select("v").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    # beyond this nothing is exact as a double, and no bound is used
    biggest = max(largest, 1.0) if largest < 1e150 else 1e300
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / (biggest := biggest * (1 + 1e-9))
    last = np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(axis=1)))
    points = np.concatenate([x, last[:, None]], axis=1)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    near, chosen = np.full(len(points), np.inf), [0]
    while len(chosen) < min(pivots, len(points)):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(np.argmax(near)))
    return Space(width, biggest, points[chosen, :-1], points[chosen, -1])


def _sorted(rows: DataFrame, space: Space, kind: str, size: int) -> DataFrame:
    """The rows with their nearest pivot and distance from it, dealt and sorted by these."""
    held = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            far = getattr(held.value, kind)(matrix(part.column(1), held.value.width))
            cell = np.argmin(far, axis=1) if len(far) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell], pa.float32())], names=["name", "v", "cell", "far"])

    first = rows.columns[0]
    name = "array<long>" if first == "ids" else "long"
    near = rows.select(F.col(first).alias("name"), "v").mapInArrow(run, f"name {name}, v array<double>, cell int, far float")
    parts = max(1, -(-rows.count() // size))
    return near.repartitionByRange(parts, "cell", "far", "name").sortWithinPartitions("cell", "far", "name")


def _pieces(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of so many, the last of fewer."""
    held, n = [], 0
    for part in batches:
        while part.num_rows:
            some = part.slice(0, size - n)
            held.append(some)
            part, n = part.slice(some.num_rows), n + some.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(found: DataFrame, space: Space, folder: str, block: int) -> DataFrame:
    """Writes the blocks; block, n, least and most (distances to the pivots, 32-bit floats)."""
    held = found.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, some in enumerate(_pieces(batches, block)):
            v = matrix(some.column("v").combine_chunks(), held.value.width)
            far = held.value.of_vectors(v)
            name = f"{task:08d}-{k:06d}.arrow"
            rows = {"v": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]), "far": pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]), "ids": some.column("name").combine_chunks()}
            common.write_arrow(folder, name, pa.table(rows))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([far.min(axis=0).tobytes()], pa.binary()), pa.array([far.max(axis=0).tobytes()], pa.binary())], names=["block", "least", "most"])

    return _sorted(found.select("ids", "v"), space, "of_vectors", WRITTEN).mapInArrow(run, "block string, least binary, most binary")


class Search:
    """One group of queries: their k best so far."""

    def __init__(self, space: Space, names: np.ndarray, q: np.ndarray, top: int):
        self.space, self.names, self.q, self.top = space, names, q, top
        self.norm = np.linalg.norm(q / space.most, axis=1) * space.most
        self.far = space.of_queries(q)
        self.exact = float(np.abs(q).max(initial=0)) * space.most * space.width < EXACT
        self.scores = np.full((len(q), top), -np.inf) if self.exact else np.full((len(q), top), None, dtype=object)
        self.ids = np.full((len(q), top), LONG, dtype=np.int64)
        self.held = np.zeros(len(q), dtype=np.int64)

    def least(self) -> np.ndarray:
        """Each query's k-th best score, -inf before there are k."""
        if self.exact:
            return self.scores[:, -1]
        return np.array([float(s) if n == self.top else -np.inf for s, n in zip(self.scores[:, -1], self.held, strict=True)])

    def bounds(self, apart: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Upper bounds of the inner products, from lower bounds of the distances on the unit sphere."""
        if not self.exact:
            return np.full(apart.shape, np.inf)
        return (self.norm[rows] * self.space.most)[:, None] * (1.0 - apart.astype(np.float64) ** 2 / 2 + MARGIN) + 1e-3

    def over_blocks(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bounds of whole blocks, from their least and greatest distance for each pivot."""
        apart = np.zeros((len(self.q), len(least)), dtype=np.float32)
        for p in range(least.shape[1]):
            own = self.far[:, p, None]
            np.maximum(apart, np.maximum(least[:, p] - own, own - most[:, p]), out=apart)
        return self.bounds(apart)

    def block(self, v: np.ndarray, far: np.ndarray, first: np.ndarray, ids: np.ndarray, active: np.ndarray) -> int:
        """Evaluates a block's vectors for the active queries in the order of their bounds; how many it did."""
        apart = np.zeros((len(active), len(v)), dtype=np.float32)
        for p in range(far.shape[1]):
            np.maximum(apart, np.abs(far[:, p] - self.far[active, p, None]), out=apart)
        bound = self.bounds(apart, active)
        over = (bound - self.least()[active, None]).max(axis=0)
        order = np.argsort(-over, kind="stable")
        done = 0
        for at in range(0, len(order), CHUNK):
            some = order[at : at + CHUNK]
            some = some[(bound[:, some] >= self.least()[active, None]).any(axis=0)]
            # the order is of the scores as they were, which only rise: vectors after these have no higher bound
            if not len(some):
                if not (bound[:, order[at:]] >= self.least()[active, None]).any():
                    break
                continue
            done += len(some)
            self._met(active, v[some], first, ids, some)
        return done

    def _met(self, active: np.ndarray, v: np.ndarray, first: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not self.exact:
            self._met_exactly(active, v, first, ids, rows)
            return
        score = self.q[active] @ v.T
        # own ids are left out later, so one more than top can matter
        k = min(self.top + 1, score.shape[1])
        floor = np.maximum(self.least()[active], np.partition(score, -k, axis=1)[:, -k])
        which, column = np.nonzero(score >= floor[:, None])
        sizes = first[rows[column] + 1] - first[rows[column]]
        spot = np.repeat(first[rows[column]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        query, found, told = np.repeat(which, sizes), ids[spot], np.repeat(score[which, column], sizes)
        other = found != self.names[active][query]
        query, found, told = query[other], found[other], told[other]
        # together with the best so far
        touched = np.unique(query)
        old = self.scores[active[touched]]
        query = np.concatenate([query, np.repeat(touched, self.top)])
        found, told = np.concatenate([found, self.ids[active[touched]].ravel()]), np.concatenate([told, old.ravel()])
        order = np.lexsort((found, -told, query))
        begins = np.searchsorted(query[order], touched)
        for j in range(self.top):
            # each query touched has its top earlier places, filled or not
            at = order[begins + j]
            self.scores[active[touched], j], self.ids[active[touched], j] = told[at], found[at]
        self.held[active[touched]] = (self.scores[active[touched]] > -np.inf).sum(axis=1)

    def _met_exactly(self, active: np.ndarray, v: np.ndarray, first: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """The same by whole numbers of any size."""
        whole = [[int(x) for x in y] for y in v]
        for i in active.tolist():
            own = [int(x) for x in self.q[i]]
            best = [(-s, n) for s, n in zip(self.scores[i, : self.held[i]], self.ids[i, : self.held[i]].tolist(), strict=True)]
            for r, y in zip(rows.tolist(), whole, strict=True):
                score = max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(own, y, strict=True))))
                best += [(-score, n) for n in ids[first[r] : first[r + 1]].tolist() if n != self.names[i]]
            best = sorted(best)[: self.top]
            self.held[i] = len(best)
            for j, (s, n) in enumerate(best):
                self.scores[i, j], self.ids[i, j] = -s, n

    def rows(self) -> pa.RecordBatch:
        which, place = np.nonzero(np.arange(self.top) < self.held[:, None])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.names[which], pa.int64()), pa.array(place + 1, pa.int32()), pa.array(self.ids[which, place], pa.int64()), pa.array([int(x) for x in self.scores[which, place]], pa.int64())],
            names=["query_id", "rank", "vec_id", "score"],
        )


def directory_of(folder: str, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All blocks' files and their least and greatest distances."""
    told = [common.read_arrow(folder, n, ["block", "least", "most"]) for n in names]
    every = pa.concat_tables(told)
    put = lambda c: np.stack([np.frombuffer(x, dtype=np.float32) for x in every.column(c).to_pylist()])
    return every.column("block").to_pylist(), put("least"), put("most")


def _put_directory(blocks: DataFrame, folder: str) -> list[str]:
    """The directory as one file of each task that has blocks; their names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            name = f"directory-{TaskContext.get().partitionId():08d}.arrow"
            common.write_arrow(folder, name, pa.Table.from_batches(rows))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return [r.name for r in blocks.coalesce(64).mapInArrow(run, "name string").collect()]


def search(df: DataFrame, wanted, key: str = "vec_id", vector: str = "embedding", top: int = TOP, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for each wanted row the rows of the largest inner products, of all others.

    wanted: a condition on the column ``id`` that picks the queries.
    """
    spark = df.sparkSession
    rows = common.shared_table(usable(df, key, vector), "vectors")
    found = common.shared_table(entries(rows, top), "entries")
    space = space_of(found, pivots, sample)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    folder = common.shared_path(spark, "blocks")
    listed = _put_directory(common.shared_table(_blocks(found, space, folder, block), "blocks"), folder)
    held = spark.sparkContext.broadcast(space)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, least, most = directory_of(folder, listed)
        for some in _pieces(batches, group):
            one = Search(held.value, np.asarray(some.column("name")), matrix(some.column("v").combine_chunks(), held.value.width), top)
            bound = one.over_blocks(least, most)
            order = np.argsort(-bound.max(axis=0), kind="stable")
            highest = bound.max(axis=0)[order]
            for k, b in enumerate(order.tolist()):
                least_score = one.least()
                if highest[k] < least_score.min():
                    break
                active = np.flatnonzero(bound[:, b] >= least_score)
                if len(active):
                    t = common.read_arrow(folder, names[b], ["v", "far", "ids"])
                    v, far, ids = (t.column(c).combine_chunks() for c in ("v", "far", "ids"))
                    one.block(np.asarray(v.flatten()).reshape(t.num_rows, -1), np.asarray(far.flatten()).reshape(t.num_rows, -1), np.asarray(ids.offsets, dtype=np.int64), np.asarray(ids.flatten()), active)
            yield one.rows()

    queries = _sorted(rows.where(wanted), space, "of_queries", 4 * group)
    return queries.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_topk: the five largest inner products of each vector whose id is divisible by 50."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


#: Whole numbers as doubles are exact below 2^53, which the scores of this table stay under.
SQL = """WITH rows AS (SELECT vec_id AS id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1),
 whole AS (SELECT id, list_transform(e, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM rows),
 pairs AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM whole q JOIN whole c ON q.id % 50 = 0 AND q.id <> c.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY rank <= 5"""
