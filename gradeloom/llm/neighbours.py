"""Operator 5: approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of CODEBOOKS full-dimensional codewords, one of each
codebook. Codebooks are trained one after the other on the residuals of a sample of SAMPLE
unit vectors at most (those of the least hashed id). Each vector is encoded by a beam search
that keeps the BEAM best partial sums, and is stored beside its codes and how far the sum is off.
A query has a table of its products with all codewords; its cosine with a stored vector is
the sum of CODEBOOKS entries, off by that distance at most. Whatever could be among the best by
this bound is reranked by exact cosine on the original vectors, so none is missed on
whatever rows; vectors that the codebooks fit badly only cost more exact products.

Equal vectors are one entry that holds their TOP + 1 least ids (copies beyond these can't be
among the nearest), thinned out in each batch before they are shuffled, so a vector that a
third of all rows share is no hot group. Every entry is indexed and scored for every query:
queries are a stated set, taken in blocks of BLOCK, each a pass over the codes with tables
of bounded size. A task returns DEPTH entries a query at most.

Vectors that are null, zero, or that hold null or non-finite components take no part, nor do
rows without an id; of rows of one id the vector first in order counts. A shorter vector's
missing components count as 0. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CODEBOOKS, WORDS, BEAM = 24, 256, 4
SAMPLE, ROUNDS = 16_384, 8
TOP, DEPTH, BLOCK = 5, 64, 1024
CHUNK = 1024
#: How far sums of single precision, and exact products, may be off by rounding.
ROUNDING, SLACK = 1e-4, 1e-9


@dataclass
class Quantiser:
    books: np.ndarray  # codebooks x words x dimensions, float32

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) of unit vectors and the norms of the sums of their codewords."""
        n = len(x)
        residual = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        for book in self.books:
            # squared distance to each word, but for the residual's own norm
            left = (residual**2).sum(axis=2)
            apart = left[:, :, None] - 2 * residual @ book.T + (book**2).sum(axis=1)
            flat = apart.reshape(n, -1)
            width = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            beam, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            residual = residual[row, beam] - book[word]
            codes = np.concatenate([codes[row, beam], word[:, :, None].astype(np.uint8)], axis=2)
        first = np.argmin((residual**2).sum(axis=2), axis=1)
        row = np.arange(n)
        return codes[row, first], np.linalg.norm(x - residual[row, first], axis=1).astype(np.float32)

    def off(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far the sums of codewords are from their vectors."""
        return np.linalg.norm(x - sum(book[codes[:, m]].astype(float) for m, book in enumerate(self.books)), axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each codebook and word its products with the queries."""
        return np.einsum("mwd,qd->mwq", self.books, queries.astype(np.float32), optimize=True)


def train(x: np.ndarray, seed: int = 0) -> Quantiser:
    """Codebooks from unit vectors, by k-means on what the earlier ones leave."""
    random = np.random.default_rng(seed)
    residual, books = x.astype(np.float32), []
    for _ in range(CODEBOOKS):
        k = min(WORDS, len(residual))
        book = residual[random.choice(len(residual), k, replace=False)].copy()
        for _ in range(ROUNDS):
            near = np.argmin((book**2).sum(axis=1) - 2 * residual @ book.T, axis=1)
            count = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            cut = np.concatenate([[0], np.cumsum(count)])[:-1]
            sums = np.add.reduceat(residual[order], np.minimum(cut, len(order) - 1), axis=0)
            used = count > 0
            book[used] = sums[used] / count[used, None]
        near = np.argmin((book**2).sum(axis=1) - 2 * residual @ book.T, axis=1)
        residual = residual - book[near]
        books.append(book)
    return Quantiser(np.stack(books))


def _even(x: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _even(x.astype(np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: the rows that take part, components as doubles, filled up with zeros to the longest."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    most = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.select("id", F.when(F.size("v") == most, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v")))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def entries(rows: DataFrame, top: int = TOP) -> DataFrame:
    """key, v, ids: distinct vectors with their least ids, top + 1 at most, ascending."""

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            keys = [xxhash.xxh3_128_digest(v.tobytes()) for v in _matrix(part.column(1)) + 0.0]
            seen: dict[bytes, list[tuple]] = {}
            for i, (k, vec_id) in enumerate(zip(keys, part.column(0).to_pylist(), strict=True)):
                seen.setdefault(k, []).append((vec_id, i))
            kept = sorted(i for x in seen.values() for _, i in sorted(x)[: top + 1])
            some = part.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([keys[i] for i in kept], pa.binary())], names=["id", "v", "key"])

    thinned = rows.mapInArrow(thin, "id long, v array<double>, key binary")
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    first = thinned.select("key", "id", "v").distinct().withColumn("place", place).where(F.col("place") <= top + 1)
    return first.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def _indexed(found: DataFrame, model: Quantiser) -> DataFrame:
    """key, id (the least), codes, off, v of every entry."""
    held = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            unit = _unit(_matrix(part.column(2)))
            codes, _ = held.value.encode(unit)
            off = held.value.off(unit, codes)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off, pa.float32()), part.column(2)], names=["key", "id", "codes", "off", "v"])

    return found.select("key", F.array_min("ids"), "v").mapInArrow(run, "key binary, id long, codes binary, off float, v array<double>")


class _Best:
    """The best entries of each query as far as they are seen: a score under the least one of its top + 1 is out."""

    def __init__(self, queries: int, top: int):
        self.best = np.full((top + 1, queries), -np.inf)
        self.query, self.score, self.id, self.key = np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, object)

    @property
    def least(self) -> np.ndarray:
        """Below it by more than rounding, an entry is not among the best."""
        return self.best.min(axis=0) - SLACK

    def add(self, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Exact scores, entries by queries; -inf where a bound has ruled an entry out."""
        most = len(self.best)
        self.best = np.partition(np.concatenate([self.best, score]), -most, axis=0)[-most:]
        row, query = np.nonzero(score >= np.maximum(self.least, -2.0))
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, score[row, query]])
        self.id, self.key = np.concatenate([self.id, ids[row]]), np.concatenate([self.key, keys[row]])
        # equal scores are settled by the smaller id, also where a task has more of them than it returns
        order = np.lexsort([self.id, -np.round(self.score, 9), self.query])
        order = order[self.score[order] >= self.least[self.query[order]]]
        query = self.query[order]
        place = np.arange(len(order)) - np.searchsorted(query, query)
        order = order[place < DEPTH]
        self.query, self.score, self.id, self.key = self.query[order], self.score[order], self.id[order], self.key[order]


def _scanned(index: DataFrame, model: Quantiser, ids: list[int], queries: np.ndarray, top: int) -> DataFrame:
    """query_id, key, near: of a task's entries those that can be among the top, for each of the queries."""
    unit = _unit(queries)
    held = index.sparkSession.sparkContext.broadcast((model.tables(unit), unit, np.array(ids, dtype=np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, unit, names = held.value
        best = _Best(len(names), top)
        for part in batches:
            for at in range(0, part.num_rows, CHUNK):
                some = part.slice(at, CHUNK)
                codes = np.frombuffer(b"".join(some.column(2).to_pylist()), dtype=np.uint8).reshape(some.num_rows, -1)
                near = tables[0][codes[:, 0]]
                for m in range(1, len(tables)):
                    near += tables[m][codes[:, m]]
                open_ = near + np.asarray(some.column(3))[:, None] + ROUNDING >= best.least
                rows = np.flatnonzero(open_.any(axis=1))
                if not len(rows):
                    continue
                few = some.take(pa.array(rows))
                score = np.where(open_[rows], _unit(_matrix(few.column(4))) @ unit.T, -np.inf)
                best.add(score, np.asarray(few.column(1)), np.array(few.column(0).to_pylist(), dtype=object))
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.key.tolist(), pa.binary()), pa.array(best.score)], names=["query_id", "key", "near"])

    return index.mapInArrow(run, "query_id long, key binary, near double")


def _reranked(pairs: DataFrame, top: int) -> DataFrame:
    """query_id, rank, vec_id, score from query_id, q, v, ids: exact cosine in double precision."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            q, v = _even(_matrix(part.column(1))), _even(_matrix(part.column(2)))
            score = np.einsum("nd,nd->n", q, v) / (np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(score)], names=["query_id", "ids", "score"])

    scored = pairs.select("query_id", "q", "v", "ids").mapInArrow(run, "query_id long, ids array<long>, score double")
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(df: DataFrame, wanted, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each wanted row's nearest among all others.

    wanted: a condition on the column ``id`` that picks the queries.
    """
    spark = df.sparkSession
    one = Window.partitionBy("id").orderBy("v")
    rows = common.shared_table(usable(df, key, vector).withColumn("place", F.row_number().over(one)).where("place = 1").select("id", "v"), "vectors")
    found = common.shared_table(entries(rows, top), "entries")
    sample = found.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = train(_unit(np.stack(sample.v.to_numpy())))
    index = common.shared_table(_indexed(found, model), "index")
    queries = rows.where(wanted)
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    near = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toPandas()
        if len(block):
            part = _scanned(index, model, block.id.tolist(), np.stack(block.v.to_numpy()), top)
            near = part if near is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kept = near.select("query_id", "key")
    pairs = kept.join(found, "key").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return _reranked(pairs, top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_neighbours: the five nearest of each vector whose id is divisible by 50."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
