"""All rows of one table against all rows of another, block by block.

Both sides are dealt to blocks by hashed id. Every block of one side meets every block of
the other in a task of its own, and only the best few of each meeting go on, so nothing is
left out, no task holds more than two blocks, and no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, blocks of a side at least (so that few rows are spread too), rows scored at once.
ROWS, LEAST, STEP = 16384, 4, 256
#: Vectors of a cell, as a mean; vectors that cells are fitted on; main directions of a sketch; rows measured at once.
CELL, SAMPLE, LINES, WIDE = 8192, 2048, 64, 1024


def sides(rows: int) -> int:
    return max(LEAST, -(-rows // ROWS))


def _met(left: DataFrame, left_id: str, right: DataFrame, right_id: str, extra: list[str], meet, schema: str) -> DataFrame:
    """meet(left block, right block) for each two blocks whose extra columns agree."""
    m, n = sides(left.count()), sides(right.count())
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    a = left.withColumn("i", own(left_id, m)).withColumn("j", spread(n))
    b = right.withColumn("j", own(right_id, n)).withColumn("i", spread(m))
    # a meeting is much work on few bytes: meetings are dealt by number, as sizes would put many of them into one task
    a, b = (x.repartition(m * n, "i", "j", *extra) for x in (a, b))
    return a.groupBy("i", "j", *extra).cogroup(b.groupBy("i", "j", *extra)).applyInArrow(meet, schema)


def _matrix(column: pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype, copy=False)


class _Cells:
    """Where vectors lie: a short sketch of each, and the cells about the centres of a sample's sketches.

    A sketch is a vector's place along the sample's main directions and how far it is from these, so sketches are
    never farther apart than their vectors. What a sketch leaves open is compared exactly.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.mean = sample.mean(axis=0)
        _, _, lines = np.linalg.svd(sample - self.mean, full_matrices=False)
        self.lines = lines[:LINES]
        y = self.sketch(sample)
        self.centres = np.unique(y, axis=0)
        if len(self.centres) > cells:
            self.centres = self.centres[np.random.default_rng(7).choice(len(self.centres), cells, replace=False)]
            for _ in range(5):
                home = self.to_centres(y).argmin(axis=1)
                self.centres = np.array([y[home == c].mean(axis=0) for c in np.unique(home)])
        gap = self.centres[:, None] - self.centres
        self.between = np.sqrt((gap**2).sum(axis=2))

    def sketch(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(self.lines) + 1))
        for at in range(0, len(rows), WIDE):
            x = rows[at : at + WIDE] - self.mean
            y = x @ self.lines.T
            out[at : at + WIDE, :-1] = y
            out[at : at + WIDE, -1] = np.sqrt(np.maximum((x**2).sum(axis=1) - (y**2).sum(axis=1), 0))
        return out

    def to_centres(self, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((y**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * y @ self.centres.T, 0))

    def asked(self, y: np.ndarray, far: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """For each sketch the cells that may hold a vector within its distance; reach: how far those of a cell are from its centre."""
        d = self.to_centres(y)
        home = d.argmin(axis=1)
        # cells are bounded by their reach, and by the planes halfway to the home's centre
        plane = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / np.maximum(2 * self.between[home], 1e-9)
        slack = 1e-5 * (1 + d.max(axis=1, initial=0.0) + np.where(np.isfinite(far), far, 0))
        return (np.maximum(d - reach, plane) <= (far + slack)[:, None]) & (reach >= 0)


def _best(q: np.ndarray, x: np.ndarray, bound: np.ndarray, cells: _Cells, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of q, those of the k nearest of x (the first of equals) and squared distances, none beyond the bound; if x is q, none is its own."""
    y, z = cells.sketch(q).astype(np.float32), cells.sketch(x).astype(np.float32)
    squares, whole = (z**2).sum(axis=1), None
    take = min(k + same, len(x))
    for at in range(0, len(q), STEP):
        line = np.arange(at, min(at + STEP, len(q)))
        own = (y[line] ** 2).sum(axis=1)
        least = own[:, None] + squares - 2 * (y[line] @ z.T)
        limit = bound[line]
        if not np.isfinite(limit).all():
            # the exact distances of those nearest by their sketches bound those of the nearest
            some = np.argpartition(least, take - 1, axis=1)[:, :take]
            told = ((q[line].astype(np.float64)[:, None] - x[some]) ** 2).sum(axis=2)
            if same:
                told[some == line[:, None]] = np.inf
            limit = np.minimum(limit, np.sort(told, axis=1)[:, k - 1] if take >= k + same else np.inf)
        slack = 1e-5 * (own + squares.max()) + 1e-3
        near = least <= (limit + slack)[:, None].astype(np.float32) * np.float32(1 + 1e-6)
        if same:
            near[np.arange(len(line)), line] = False
        if np.count_nonzero(near) * 40 <= near.size:
            i, j = np.divmod(np.flatnonzero(near), len(x))
            d = np.concatenate([((q[line[i[a : a + WIDE]]].astype(np.float64) - x[j[a : a + WIDE]]) ** 2).sum(axis=1) for a in range(0, len(i), WIDE)] or [np.zeros(0)])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.searchsorted(i, i)
            kept = (np.arange(len(i)) - first < k) & (d <= bound[line[i]])
            yield line[i[kept]], j[kept], d[kept]
            continue
        whole = x.astype(np.float64) if whole is None else whole
        part = q[line].astype(np.float64)
        d = (part**2).sum(axis=1)[:, None] + np.einsum("ij,ij->i", whole, whole) - 2 * part @ whole.T
        if same:
            d[np.arange(len(line)), line] = np.inf
        for _ in range(min(k, len(x))):
            best = d.argmin(axis=1)  # the first of equals, that of the smallest id
            told = d[np.arange(len(line)), best].copy()
            found = np.isfinite(told) & (told <= bound[line])
            yield line[found], best[found], told[found]
            d[np.arange(len(line)), best] = np.inf


def nearest(vectors: DataFrame, k: int = 3) -> DataFrame:
    """id, known_id, label, far, place: the k nearest other vectors of each, ties by known_id.

    vectors: id (each once), label, v (integers of one length, so that squared distances are exact in doubles); those
    with a null take no part. A vector's nearest in the block of its own cell bound how far its nearest can be; it then
    goes to those cells alone that reach so far, and there sketches tell which vectors are compared.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", "label", "v").where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    n, width, low, high = vectors.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    schema = f"id {types['id']}, known_id {types['id']}, label {types['label']}, far double"
    if not n or not width:
        return spark.createDataFrame([], f"{schema}, place int")
    kind = next(t for t in (np.uint8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    unpack = lambda b: np.frombuffer(b"".join(b), dtype=kind).reshape(-1, width)
    few = max(1, n // SAMPLE)
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(few)) == 0).select("v").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = vectors.select("v").limit(1).toArrow()
    model = spark.sparkContext.broadcast(_Cells(_matrix(sample.column("v"), width, np.float64), min(512, max(LEAST, n // CELL))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = model.value
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            d = cells.to_centres(cells.sketch(x))
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(home, pa.int32()), pa.array(d[np.arange(len(x)), home], pa.float64())], ["id", "label", "b", "home", "away"])

    placed = vectors.mapInArrow(pack, f"id {types['id']}, label {types['label']}, b binary, home int, away double").persist()
    sizes = {r.home: r for r in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()}
    reach = np.array([sizes[c].reach * (1 + 1e-9) if c in sizes else -np.inf for c in range(len(model.value.centres))])
    cuts = [-(-sizes[c].n // ROWS) if c in sizes else 0 for c in range(len(reach))]
    number = F.get(F.array(*map(F.lit, cuts)), F.col("home"))
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("id"), number).cast("int"))

    def at_home(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = unpack(t.column("b").to_pylist())
        found = list(_best(x, x, np.full(len(x), np.inf), model.value, k, True))
        i, j, d = (np.concatenate([f[c] for f in found]) for c in range(3))
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        begin = np.searchsorted(i, np.arange(len(x) + 1))
        last = np.full(len(x), np.inf)
        full = np.diff(begin) >= k
        last[full] = d[begin[1:][full] - 1]
        split = pa.array(begin, pa.int32())
        known = pa.StructArray.from_arrays([t.column("id").combine_chunks().take(pa.array(j)), t.column("label").combine_chunks().take(pa.array(j)), pa.array(d, pa.float64())], ["known_id", "label", "far"])
        wants = np.concatenate([model.value.asked(model.value.sketch(x[p : p + WIDE]), np.sqrt(last[p : p + WIDE]), reach) for p in range(0, len(x), WIDE)])
        asked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], wants.sum(axis=1).cumsum()]), pa.int32()), pa.array(np.nonzero(wants)[1], pa.int32()))
        return pa.table({"id": t.column("id"), "b": t.column("b"), "home": t.column("home"), "cut": t.column("cut"), "last": pa.array(last), "near": pa.ListArray.from_arrays(split, known), "asked": asked})

    own = f"id {types['id']}, b binary, home int, cut int, last double, near array<struct<known_id:{types['id']},label:{types['label']},far:double>>, asked array<int>"
    homes = placed.repartition(sum(cuts), "home", "cut").groupBy("home", "cut").applyInArrow(at_home, own).persist()
    wanted = {r.cell: r.n for r in homes.select(F.explode("asked").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-wanted.get(c, 0) // (2 * ROWS))) for c in range(len(reach))]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": left.column("id").slice(0, 0), "known_id": right.column("known_id").slice(0, 0), "label": right.column("label").slice(0, 0), "far": pa.array([], pa.float64())})
        right = right.sort_by("known_id")
        found = list(_best(unpack(left.column("b").to_pylist()), unpack(right.column("x").to_pylist()), left.column("last").to_numpy(), model.value, k, False))
        i, j, d = (np.concatenate([f[c] for f in found]) for c in range(3))
        return pa.table({"id": left.column("id").take(pa.array(i)), "known_id": right.column("known_id").take(pa.array(j)), "label": right.column("label").take(pa.array(j)), "far": pa.array(d, pa.float64())})

    of = lambda numbers, c: F.get(F.array(*map(F.lit, numbers)), F.col(c))
    each = lambda numbers, c: F.explode(F.sequence(F.lit(0), of(numbers, c) - 1))
    left = homes.select("id", "b", "last", F.col("home").alias("own_home"), F.col("cut").alias("own_cut"), F.explode("asked").alias("home")).withColumn("cut", each(cuts, "home"))
    left = left.where("home <> own_home OR cut <> own_cut").withColumn("part", F.pmod(F.xxhash64("id"), of(parts, "home")).cast("int")).select("id", "b", "last", "home", "cut", "part")
    right = placed.select(F.col("id").alias("known_id"), "label", F.col("b").alias("x"), "home", "cut", each(parts, "home").alias("part"))
    # a meeting is much work on few bytes: meetings are dealt by number
    many = sum(c * p for c, p in zip(cuts, parts, strict=True))
    left, right = (t.repartition(many, "home", "cut", "part") for t in (left, right))
    others = left.groupBy("home", "cut", "part").cogroup(right.groupBy("home", "cut", "part")).applyInArrow(meet, schema)
    both = homes.select("id", F.explode("near").alias("n")).select("id", "n.known_id", "n.label", "n.far").unionByName(others)
    near = Window.partitionBy("id").orderBy("far", "known_id")
    return both.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)


def nearest_of(queries: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """id, known_id, label, far, place: of the known vectors the k nearest to each query, ties by known_id.

    queries: id (each once), q. known: known_id, label, x (of the same length as q, which is small). Squares of
    differences are summed component by component, so values need not be integers. Vectors with a null take no part.
    """
    types = {f.name: f.dataType.simpleString() for t in (queries, known) for f in t.schema.fields}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = left.schema.empty_table().column("id"), right.schema.empty_table()
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": none[0], "known_id": none[1].column("known_id"), "label": none[1].column("label"), "far": pa.array([], pa.float64())})
        right = right.sort_by("known_id")
        width = len(left.column("q")[0])
        q, x = _matrix(left.column("q"), width, np.float64), _matrix(right.column("x"), width, np.float64)
        rows, to, far = [], [], []
        for at in range(0, len(q), STEP):
            part = q[at : at + STEP]
            d = np.zeros((len(part), len(x)))
            for c in range(width):
                d += (part[:, c, None] - x[:, c]) ** 2
            line = np.arange(len(part))
            for _ in range(min(k, len(x))):
                best = d.argmin(axis=1)  # the first of equals, that of the smallest id
                found = np.isfinite(d[line, best])
                rows.append(at + line[found])
                to.append(best[found])
                far.append(d[line, best][found])
                d[line, best] = np.inf
        rows, to = pa.array(np.concatenate(rows)), pa.array(np.concatenate(to))
        return pa.table({"id": left.column("id").take(rows), "known_id": right.column("known_id").take(to), "label": right.column("label").take(to), "far": pa.array(np.concatenate(far))})

    whole = lambda c: ~F.exists(c, lambda v: v.isNull())
    few = _met(queries.select("id", "q").where(whole("q")), "id", known.select("known_id", "label", "x").where(whole("x")), "known_id", [], meet, f"id {types['id']}, known_id {types['known_id']}, label {types['label']}, far double")
    near = Window.partitionBy("id").orderBy("far", "known_id")
    return few.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)


def best_rolls(reads: DataFrame, rolls: DataFrame) -> DataFrame:
    """id, roll_no, size, logs, second: each read's best roll of its length, and the next one's log score.

    reads: id (each once), probs (arrays by place of ten probabilities). rolls: roll_no (each once), digits, n (how often
    its log score counts). Scores are compared to nine places, ties go to the first roll by name.
    """
    kind = reads.schema["id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": left.column("id").slice(0, 0), "roll_no": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "logs": pa.array([], pa.float64())})
        right = right.sort_by("roll_no")
        size = left.column("size")[0].as_py()
        given = np.array([[[np.nan if x is None else x for x in (p or [])[:10]] + [np.nan] * (10 - len((p or [])[:10])) for p in probs] for probs in left.column("probs").to_pylist()], dtype=np.float64)
        # an unknown probability, and what is no digit, count as 1e-6
        logs = np.log(np.concatenate([np.fmax(given, 1e-6), np.full((len(given), size, 1), 1e-6)], axis=2))
        digits = np.array([[int(c) if c in "0123456789" else 10 for c in d] for d in right.column("digits").to_pylist()])
        often = right.column("n").to_numpy().astype(np.float64)
        rows, to, told = [], [], []
        for at in range(0, len(logs), STEP):
            part = logs[at : at + STEP]
            # place by place, so that equal digits have equal sums
            total = np.zeros((len(part), len(digits)))
            for p in range(size):
                total += part[:, p][:, digits[:, p]]
            total = np.round(total * often, 9)
            line = np.arange(len(part))
            for _ in range(min(2, len(digits))):
                best = total.argmax(axis=1)
                rows.append(at + line)
                to.append(best)
                told.append(total[line, best].copy())
                total[line, best] = -np.inf
        rows, to = pa.array(np.concatenate(rows)), pa.array(np.concatenate(to))
        return pa.table({"id": left.column("id").take(rows), "roll_no": right.column("roll_no").take(to), "size": pa.array(np.full(len(rows), size), pa.int32()), "logs": pa.array(np.concatenate(told))})

    left = reads.select("id", "probs", F.size("probs").alias("size")).where("size > 0")
    right = rolls.select("roll_no", "digits", "n", F.length("digits").alias("size"))
    few = _met(left, "id", right, "roll_no", ["size"], meet, f"id {kind}, roll_no string, size int, logs double")
    order = Window.partitionBy("id").orderBy(F.desc("logs"), "roll_no")
    return few.withColumn("second", F.lead("logs").over(order)).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
