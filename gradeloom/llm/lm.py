"""Operator 4: language-model scores by logistic context mixing (``mixing``) over word tokens.

Tokens are a text's words, A-Z lower-cased, and an end. The base score is that of add-one
smoothed token counts. The model reads a text in its order, in stretches: a stretch ends after
a token whose hash says so (one in STRETCH) or with the text. Whether a stretch is one that
training texts hold is a binary decision, predicted from the stretch before it by what was
counted over all training texts and, more and more, by this text's own decisions so far. A
known stretch has its share of all stretches; an unknown one the probability of its tokens,
byte by byte, under the mixed bit predictors (a text is of one of KINDS kinds, clusters of
byte pairs found on all training texts; that costs log10(KINDS) and is part of every context).
A known stretch counts with both ways. Of a text that was learned from, its own stretches are
left out of their counts, so a text that occurs once is not known by itself.

1. Training texts give counts by kind and token, and of stretches, each task's summed before the
   shuffle. All corpus statistics come from these: N, V, the predictors' tables (each task sums
   tables of fixed size, which are added up in two steps), the mixing weights (each task learns
   online over its tokens; the tasks' weights are averaged by what they have seen), and the table
   of stretches, which grows with the corpus and stays distributed.
2. Scoring: the HOT most frequent (kind, token) go to every task with count and score. Other
   tokens are scored by the model in the task, and kept up to a bound; their counts come by a join
   with the table of counts, whose rows, like the tokens', are dealt by token: frequent ones
   are hot already, so none is a large group. Stretches are joined likewise: those that make up
   1 / HOT_STRETCHES of all are at most so many, and are broadcast. Sums by document end it.

Null text: empty, so the end alone. Null doc_id: learned from. Repeated rows count and are
scored each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import common
from .mixing import FIRST, Model, Weights, counted, shrunk
from .places import Grown
from .shingles import mixed

KINDS, HOT = 8, 500_000
#: Centres of a task's texts, and passes over all texts that move the centres of KINDS.
PARTS, PASSES = 16, 2
#: Texts that are scored together: tokens new to the task are scored once for all of them.
TOGETHER, TOGETHER_BYTES = 512, 3 << 20
#: Tokens that aren't hot whose scores a worker keeps.
KEPT = 100_000
#: Distinct tokens that a task counts before it passes them on; places of byte pairs.
MAX_COUNTED, PAIRS = 150_000, 2048
CHUNKS, FEW = 64, 32
PART_NAMES = ["rid", "key", "learned", "token", "times", "base", "known", "n", "bytes", "hashes", "own", "logs"]
#: A token that no text can hold, and what the model reads for it: no byte before the space.
END, END_BYTES = b" ", b""
#: A token in so many ends a stretch; stretches that are broadcast, at most; the kind of their counts.
STRETCH, HOT_STRETCHES, STRETCHES = 64, 50_000, -1


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _pairs(texts: list[str | None]) -> np.ndarray:
    """For each text the square roots of the shares of its byte pairs (32 bits)."""
    out = np.zeros((len(texts), PAIRS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8).astype(np.uint16)
        # PAIRS divides 2 ** 16, so numbers may run over
        n = np.bincount((b[:-1] * np.uint16(251) + b[1:]) & np.uint16(PAIRS - 1), minlength=PAIRS)
        row[:] = n
        row /= max(1, len(b) - 1)
    return np.sqrt(out, out=out)


def clustered(x: np.ndarray, weights: np.ndarray, k: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """k centres at most of weighted points (k-means), and their weights. Each first centre is where most is lost without it."""
    if len(x) <= k:
        return x, weights
    squares = (x**2).sum(axis=1)
    away = lambda c: np.maximum(0, squares - 2 * (x @ c) + c @ c)
    far = [int(np.argmax(weights))]
    lost = away(x[far[0]])
    while len(far) < k:
        far.append(int(np.argmax(lost * weights)))
        lost = np.minimum(lost, away(x[far[-1]]))
    centres = x[far]
    for _ in range(rounds):
        sums, mass = _sums(x, weights, centres)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)
    mass = _sums(x, weights, centres)[1]
    return centres[mass > 0], mass[mass > 0]


def _sums(x: np.ndarray, weights: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the points nearest to each centre, and their weights'."""
    near = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    own = (near == np.arange(len(centres))[:, None]) * weights
    return own @ x, own.sum(axis=1)


def kinds_of(df: DataFrame, text: str) -> np.ndarray:
    """Centres of KINDS clusters of the byte pairs of all texts.

    Each task clusters its texts, batch by batch, into PARTS weighted centres; those of all tasks give the
    first centres, and PASSES passes over all texts, summed in each task, move them to the means.
    """
    spark = df.sparkSession
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    kind = "at int, pairs binary, mass double"

    def told(x: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary()), pa.array(mass, pa.float64())], names=["at", "pairs", "mass"])

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for rows in common.smaller(batches):
            if rows.num_rows:
                yield _pairs(rows.column(0).to_pylist())

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what an earlier model has kept in the worker goes
        common.alone("lm training", lambda: None)
        x, mass = np.zeros((0, PAIRS), dtype=np.float32), np.zeros(0)
        for more in points(batches):
            found, n = clustered(more, np.ones(len(more), dtype=np.float32), PARTS)
            x, mass = np.concatenate([x, found]), np.concatenate([mass, n])
            if len(x) > 8 * PARTS:
                x, mass = clustered(x, mass.astype(np.float32), PARTS)
        if len(x):
            yield told(*clustered(x, mass.astype(np.float32), PARTS))

    def read(rows: list) -> np.ndarray:
        return np.stack([np.frombuffer(bytes(r.pairs), dtype=np.float32) for r in rows]).astype(np.float64)

    rows = texts.mapInArrow(first, kind).collect()
    if not rows:
        return np.zeros((1, PAIRS))
    centres, _ = clustered(read(rows), np.array([r.mass for r in rows]), KINDS, 12)
    for _ in range(PASSES):
        held = spark.sparkContext.broadcast(centres.astype(np.float32))

        def summed(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums, mass = np.zeros(held.value.shape), np.zeros(len(held.value))
            for x in points(batches):
                more, n = _sums(x, np.ones(len(x), dtype=np.float32), held.value)
                sums, mass = sums + more, mass + n
            yield told(sums, mass)

        rows = texts.mapInArrow(summed, kind).collect()
        sums, mass = np.zeros(centres.shape), np.zeros(len(centres))
        for r in rows:
            sums[r.at] += np.frombuffer(bytes(r.pairs), dtype=np.float32)
            mass[r.at] += r.mass
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1)[:, None], centres)
        held.destroy()
    return centres


def _kinds(texts: list[str | None], centres: np.ndarray) -> list[int]:
    """The nearest centre of each text; 0 for those of less than two characters."""
    centres = centres.astype(np.float32)
    out = np.zeros(len(texts), dtype=np.int64)
    for at in range(0, len(texts), 256):
        some = texts[at : at + 256]
        near = np.argmax(_pairs(some) @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        out[at : at + 256] = np.where([len(t or "") > 1 for t in some], near, 0)
    return out.tolist()


def _kind(text: str | None, centres: np.ndarray) -> int:
    return _kinds([text], centres)[0]


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def stretches(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin and a hash of each, over the tokens of texts that end at the given places."""
    last = (hashes & np.uint64(STRETCH - 1)) == 0
    last[ends - 1] = True
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(starts, append=len(hashes)))
    with np.errstate(over="ignore"):
        own = mixed(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return starts, mixed(np.add.reduceat(own, starts))


class _Counted:
    """Counts by kind and token, and of stretches, of a task's texts."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.fresh: list[bytes] = []
        self.hashes = Grown("u8")
        self.counts: dict[int, np.ndarray] = {}
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def __getitem__(self, token: bytes) -> int:
        found = self.places.get(token)
        if found is None:
            found = self.places[token] = len(self.places)
            self.fresh.append(token)
        return found

    def add(self, texts: list[tuple[int, list[bytes]]]) -> None:
        ids = [np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)) for _, words in texts]
        self.hashes.extend(token_hashes(self.fresh))
        self.fresh.clear()
        for kind in {k for k, _ in texts}:
            n = np.bincount(np.concatenate([x for x, (k, _) in zip(ids, texts, strict=True) if k == kind]), minlength=len(self.places))
            before = self.counts.get(kind)
            if before is not None:
                n[: len(before)] += before
            self.counts[kind] = n
        every = np.concatenate(ids)
        found = stretches(self.hashes.data[every], np.cumsum([len(x) for x in ids]))[1]
        self.waiting.append(found)
        self.n_waiting += len(found)

    def full(self) -> bool:
        return len(self.places) > MAX_COUNTED or self.n_waiting > 8 * MAX_COUNTED

    def told(self) -> Iterator[pa.RecordBatch]:
        names = ["kind", "token", "hash", "n"]
        tokens = pa.array(list(self.places), pa.binary())
        for kind, n in self.counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), tokens.take(pa.array(at)), pa.nulls(len(at), pa.int64()), pa.array(n[at], pa.int64())], names=names)
        if self.waiting:
            found, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), STRETCHES), pa.int32()), pa.nulls(len(found), pa.binary()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=names)
        self.__init__()


def count_tokens(df: DataFrame, centres: np.ndarray, text: str = "text") -> DataFrame:
    """kind, token, hash, n over all rows of df: tokens by kind, and of kind STRETCHES the hashes of stretches."""
    held = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("lm training", lambda: None)
        counted_ = _Counted()
        for rows in common.portions(batches, 0, TOGETHER, TOGETHER_BYTES):
            texts = rows.column(0).to_pylist()
            counted_.add([(kind, [*common.words(value), END]) for kind, value in zip(_kinds(texts, held.value), texts, strict=True)])
            if counted_.full():
                yield from counted_.told()
        yield from counted_.told()

    return df.select(F.col(text).alias("text")).mapInArrow(run, "kind int, token binary, hash long, n long").groupBy("kind", "token", "hash").agg(F.sum("n").alias("n"))


def _tokens(rows: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words = [END_BYTES if t == END else t for t in rows.column(1).to_pylist()]
    return words, np.asarray(rows.column(0)), np.asarray(rows.column(2))


def train_tables(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The predictors' tables of 1s and of all decisions, summed over all tasks."""
    size = -(-int(FIRST[-1]) // CHUNKS)

    tasks = counts.rdd.getNumPartitions()
    groups = 1 if tasks <= FEW else round(tasks**0.5)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, every = np.zeros(FIRST[-1], dtype=np.float32), np.zeros(FIRST[-1], dtype=np.float32)
        for rows in batches:
            words, kinds, n = _tokens(rows)
            counted(words, kinds, n, ones, every)
        own = TaskContext.get().partitionId() % groups
        if every.any():
            for c in range(CHUNKS):
                both = np.stack([ones[c * size : (c + 1) * size], every[c * size : (c + 1) * size]])
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([own], pa.int32()), pa.array([both.tobytes()], pa.binary())], names=["chunk", "grp", "data"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for rows in common.smaller(batches, 16):
            for c, g, data in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                one = np.frombuffer(data, dtype=np.float32)
                total[c, g] = total[c, g] + one if (c, g) in total else one.astype(np.float64)
        at = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in at], pa.int32()), pa.array([g for _, g in at], pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["chunk", "grp", "data"])

    kind = "chunk int, grp int, data binary"
    parts = counts.select("kind", "token", "n").mapInArrow(part, kind)
    if groups > 1:
        # about the square root of the tasks meet in a first sum, and as many in the second
        parts = parts.repartition(CHUNKS * groups, "chunk", "grp").mapInArrow(summed, kind).withColumn("grp", F.lit(0))
    rows = parts.repartition(CHUNKS, "chunk").mapInArrow(summed, kind).collect()
    ones, every = np.zeros(FIRST[-1]), np.zeros(FIRST[-1])
    for r in rows:
        both = np.frombuffer(bytes(r.data), dtype=np.float32).reshape(2, -1)
        ones[r.chunk * size : (r.chunk + 1) * size], every[r.chunk * size : (r.chunk + 1) * size] = both
    return ones, every


def train_weights(counts: DataFrame, ones: np.ndarray, every: np.ndarray) -> Weights:
    """Mixing weights and adaptive map: learned in each task, averaged by tokens, summed."""
    held = counts.sparkSession.sparkContext.broadcast(shrunk(ones, every))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = Weights(), 0
        for rows in batches:
            words, kinds, n = _tokens(rows)
            weights.learn(words, kinds, n, *held.value)
            seen += int(n.sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([weights.mix.tobytes()], pa.binary()), pa.array([weights.map.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["mix", "map", "seen"])

    out, total = Weights(), 0
    mix = np.zeros_like(out.mix)
    for r in counts.select("kind", "token", "n").mapInArrow(run, "mix binary, map binary, seen long").collect():
        mix += np.frombuffer(bytes(r.mix)).reshape(mix.shape) * r.seen
        out.map += np.frombuffer(bytes(r.map)).reshape(out.map.shape)
        total += r.seen
    if total:
        out.mix = mix / total
    held.destroy()
    return out


def _least_hot(counts: DataFrame) -> int:
    """The least count at which no more than HOT (kind, token) are as frequent, to a sixteenth of a doubling."""
    step = F.floor(16 * F.log2("n")).cast("int").alias("step")
    left = HOT
    least = None
    for r in counts.groupBy(step).agg(F.count("*").alias("many"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        left -= r.many
        if left < 0:
            break
        least = r.n
    return least if least is not None else 1 << 62


class _Places(dict):
    """Place of each token of a kind: hot ones, then others as they come."""

    def __init__(self, hot: dict[bytes, int], new: list, kind: int):
        super().__init__(hot)
        self.new, self.kind = new, kind

    def __missing__(self, token: bytes) -> int:
        self[token] = place = -1 - len(self.new)
        self.new.append((self.kind, token))
        return place


_ready: dict = {}


def _prepared(key: str, hot: tuple) -> tuple:
    """The hot tokens' places by kind, their counts' logarithms, scores and hashes; kept while the model is in use."""
    if key not in _ready:
        _ready.clear()
        kinds, joined, sizes, counts, scores = hot
        places: dict[int, dict[bytes, int]] = {}
        at, tokens = 0, []
        for i, (kind, size) in enumerate(zip(kinds.tolist(), sizes.tolist(), strict=True)):
            tokens.append(joined[at : at + size])
            places.setdefault(kind, {})[tokens[-1]] = i
            at += size
        new: list = []
        _ready[key] = {k: _Places(p, new, k) for k, p in places.items()}, new, (Grown("f8"), Grown("u8")), np.log10(counts + 1.0), scores, token_hashes(tokens)
    return _ready[key]


def _line_score(xs: Column, prior: Column) -> Column:
    """The log10 probability of a text's stretches (in order; t: that of its tokens, r: of the known stretch, else null).

    Whether a stretch is known is predicted from whether the one before is: by the corpus' rates (prior, two of
    them), which count as two decisions, and this text's decisions so far.
    """

    def step(acc: Column, x: Column) -> Column:
        seen, known = F.when(acc["last"], acc["n1"]).otherwise(acc["n0"]), F.when(acc["last"], acc["k1"]).otherwise(acc["k0"])
        p = (known + 2 * F.when(acc["last"], prior["p1"]).otherwise(prior["p0"])) / (seen + 2)
        yes = x["r"].isNotNull()
        a, b = F.log10(p) + x["r"], F.log10(1 - p) + x["t"]
        both = F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))
        one = F.when(yes, 1.0).otherwise(0.0)
        grown = lambda name, on, by: (acc[name] + F.when(on, by).otherwise(0.0)).alias(name)
        return F.struct(
            (acc["sum"] + F.when(yes, both).otherwise(b)).alias("sum"), yes.alias("last"),
            grown("n0", ~acc["last"], F.lit(1.0)), grown("k0", ~acc["last"], one), grown("n1", acc["last"], F.lit(1.0)), grown("k1", acc["last"], one),
        )

    zero = F.lit(0.0)
    start = F.struct(zero.alias("sum"), F.lit(False).alias("last"), zero.alias("n0"), zero.alias("k0"), zero.alias("n1"), zero.alias("k1"))
    return F.aggregate(xs, start, step, lambda acc: acc["sum"])


def _stretch_scores(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """rid, score from parts' rid, learned, hashes, own (how often the text has each) and logs (its tokens' probability)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = counts.select("hash", "n")
    each = parts.select("rid", "learned", F.posexplode(F.arrays_zip("hashes", "own", "logs")).alias("at", "x")).select("rid", "learned", "at", F.col("x.hashes").alias("hash"), F.col("x.own").alias("own"), F.col("x.logs").alias("t"))
    often = F.col("n") >= max(2.0, total / HOT_STRETCHES)
    named = each.join(F.broadcast(table.where(often).withColumnRenamed("n", "hot")), "hash", "left")
    rare = named.where("hot IS NULL").drop("hot").join(table.where(~often), "hash", "left")
    met = rare.unionByName(named.where("hot IS NOT NULL").withColumnRenamed("hot", "n"))
    left = F.coalesce("n", F.lit(0)) - F.when(F.col("learned"), F.col("own")).otherwise(0)
    r = F.when(left > 0, F.log10(left / F.lit(float(max(1, total)))))
    lines = common.shared_table(met.groupBy("rid", "learned").agg(F.array_sort(F.collect_list(F.struct("at", "t", r.alias("r")))).alias("xs")), "stretches")
    after = F.transform("xs", lambda x, i: F.struct((F.when(i > 0, F.get("xs", i - 1)["r"].isNotNull()).otherwise(False)).alias("last"), x["r"].isNotNull().alias("known")))
    told = lines.where("learned").select(F.explode(after).alias("x")).groupBy("x.last").agg(F.count("*").alias("n"), F.count_if("x.known").alias("k")).collect()
    rates = {t["last"]: (t.k + 0.5) / (t.n + 1) for t in told}
    prior = F.struct(F.lit(rates.get(False, 0.05)).alias("p0"), F.lit(rates.get(True, 0.5)).alias("p1"))
    return lines.select("rid", _line_score(F.col("xs"), prior).alias("score"))


def score(df: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", learned: Column | None = None) -> DataFrame:
    """rid, key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row for each of df, learned from train.

    learned: a condition that holds for those rows of df that are in train; their own stretches are left out.
    """
    spark = df.sparkSession
    centres = kinds_of(train, text)
    every_count = common.shared_table(count_tokens(train, centres, text), "counts")
    counts = every_count.where(F.col("kind") != STRETCHES)
    by_token = common.shared_table(counts.groupBy("token").agg(F.sum("n").alias("c")), "tokens")
    totals = by_token.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ones, every = train_tables(counts)
    weights = train_weights(counts, ones, every)
    model = Model.of(ones, every, weights)
    held = spark.sparkContext.broadcast((model, centres))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words, kinds, _ = _tokens(rows)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held.value[0].score(words, kinds))], names=["kind", "token", "c", "score"])

    top = counts.where(F.col("n") >= _least_hot(counts)).select("kind", "token")
    hot = top.join(by_token, "token").select("kind", "token", "c").mapInArrow(scored, "kind int, token binary, c long, score double").toArrow()
    tokens = hot.column("token").to_pylist()
    sent = spark.sparkContext.broadcast((hot.column("kind").to_numpy(), b"".join(tokens), np.array([len(t) for t in tokens], dtype=np.int64), hot.column("c").to_numpy(), hot.column("score").to_numpy()))
    name = uuid.uuid4().hex
    n, v = totals.n, totals.v

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("lm", _ready.clear)
        model, centres = held.value
        places, new, (new_scores, new_hashes), logs, scores, hashes = _prepared(name, sent.value)
        for rows in common.portions(batches, 2, TOGETHER, TOGETHER_BYTES):
            ids, sizes = [], []
            values = rows.column(2).to_pylist()
            for kind, value in zip(_kinds(values, centres), values, strict=True):
                own = places.get(kind)
                if own is None:
                    own = places[kind] = _Places({}, new, kind)
                words = common.words(value)
                words.append(END)
                ids.append(np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=len(words)))
                sizes.append(len((value or "").encode("utf-8")))
            fresh = new[new_scores.n :]
            if fresh:
                new_hashes.extend(token_hashes([t for _, t in fresh]))
                new_scores.extend(model.score([END_BYTES if t == END else t for _, t in fresh], np.array([k for k, _ in fresh], dtype=np.int64)))
            texts, lengths = len(ids), np.array([len(x) for x in ids], dtype=np.int64)
            ends = np.cumsum(lengths)
            at = np.concatenate(ids)
            row, warm = np.repeat(np.arange(texts), lengths), at >= 0
            # new tokens count from the end: -1 is the first of them
            every_score = np.concatenate([scores, new_scores.data[: len(new)][::-1]])[at]
            every_hash = np.concatenate([hashes, new_hashes.data[: len(new)][::-1]])[at]
            base = np.bincount(row[warm], weights=logs[at[warm]], minlength=texts)
            known = np.bincount(row[warm], minlength=texts)
            # of each text's cold tokens how often they are there
            pairs, times = np.unique(row[~warm] * (len(new) + 1) + (-1 - at[~warm]), return_counts=True)
            cold_row, cold = np.divmod(pairs, len(new) + 1)
            starts, found = stretches(every_hash, ends)
            sums = np.add.reduceat(every_score, starts)
            lines = np.searchsorted(starts, np.concatenate([[0], ends]))
            with np.errstate(over="ignore"):
                _, inverse, times_own = np.unique(mixed(found ^ mixed(np.repeat(np.arange(texts), np.diff(lines)).astype(np.uint64))), return_inverse=True, return_counts=True)
            listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pa.array(values, kind))
            none = lambda k, kind: pa.nulls(k, kind)
            long, double = pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(3), none(texts, pa.binary()), pa.array(np.zeros(texts), long), pa.array(base), pa.array(known, long), pa.array(lengths), pa.array(sizes, long),
                 listed(found.view(np.int64), long), listed(times_own[inverse.ravel()], long), listed(sums, double)],
                names=PART_NAMES,
            )
            k = len(cold)
            took = pa.array(cold_row)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(took), rows.column(1).take(took), rows.column(3).take(took), pa.array([new[c][1] for c in cold.tolist()], pa.binary()), pa.array(times, long), pa.array(np.zeros(k)), pa.array(np.zeros(k), long), pa.array(np.zeros(k), long), pa.array(np.zeros(k), long),
                 none(k, pa.list_(long)), none(k, pa.list_(long)), none(k, pa.list_(double))],
                names=PART_NAMES,
            )
            if len(new) > KEPT:
                for kind, token in new:
                    del places[kind][token]
                new.clear()
                new_scores.n = new_hashes.n = 0

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.lit(False) if learned is None else learned, F.lit(False)).alias("learned"))
    schema = f"rid long, key {kind}, learned boolean, token binary, times long, base double, known long, n long, bytes long, hashes array<long>, own array<long>, logs array<double>"
    parts = common.shared_table(rows.mapInArrow(run, schema), "parts")
    # all texts are scored: workers need not keep the model and the hot tokens
    held.destroy()
    sent.destroy()
    # a text's own row has no token; it meets no count
    met = parts.drop("hashes", "own", "logs").join(by_token, "token", "left")
    known = F.col("known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)
    base = F.col("base") + F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1)).otherwise(0.0)
    sums = met.groupBy("rid", "key").agg(F.sum("n").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("logs"), F.sum("bytes").alias("bytes"))
    lines = _stretch_scores(parts.where("hashes IS NOT NULL"), every_count.where(F.col("kind") == STRETCHES))
    told = sums.join(lines.withColumn("score", F.col("score") - math.log10(len(centres))), "rid")
    return told.select(
        "rid", F.col("key").alias(key), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
        (-F.col("score") / math.log10(2) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_lm_scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = ~held_out(F.col("doc_id"))
    told = score(documents, documents.where(learned), learned=learned)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
