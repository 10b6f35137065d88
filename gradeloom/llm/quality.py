"""Operator 1: document quality by hierarchical empirical Bayes.

1. A logistic classifier is fitted on SAMPLE labelled documents at most (those of the least
   hashed id): statistics of the text and hashed words. Good is quality 1 and not toxic.
2. It scores every whole text. Each document's chance of being good, its label where there
   is one, is summed by path and host. No group is gathered: sums are partial before they
   are shuffled, and joins on a hot host are ones that Spark splits.
3. A host's rate is shrunk towards the corpus', a path's towards its host's:
   (sum + k * above) / (n + k). k comes from the spread of the rates, by the method of
   moments: where hosts hardly differ beyond chance, k is large. A document's own part is
   left out of the rates that judge it, so a sparse site gets its host's or the corpus' rate.
4. Posterior log odds: the classifier's, with the share of good documents in its sample
   replaced by the path's rate. A document is kept if it is likelier good than not.

Null or empty texts have no evidence but their site's and are not kept. Null hosts and paths
are groups of their own. Several labels of a document: the worse counts. Without labels of
both kinds nothing can be learned, and all documents with text are kept at score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the classifier is fitted on at most; places of hashed words.
SAMPLE, PLACES = 8192, 1 << 14
STEPS, PENALTY = 300, 3e-4
#: A place of words counts if so many documents of the sample have it.
SEEN = 8
#: Bounds of the weight k of the level above.
LEAST_K, MOST_K = 1.0, 1e4

SYMBOLS = b"#$%&*|!<>{}[]=+_~^\\/"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
STATS = 8


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?\"'()")) & (PLACES - 1)
        self[word] = found
        return found


_places = _Places()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of a text, and the places of its words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = np.bincount(np.fromiter(map(_places.__getitem__, words), dtype=np.int64, count=len(words)), minlength=1)
    lines = raw.split(b"\n")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    stats = np.array([
        np.log1p(len(words)), min(20.0, size / n), len(set(words)) / n, share(SYMBOLS), share(UPPER), share(DIGITS),
        1 - len(set(lines)) / len(lines), counts.max() / n,
    ])
    return stats, np.flatnonzero(counts)


@dataclass
class Classifier:
    """Weights of the standardised statistics and of the words; prior: the sample's log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    bias: float
    prior: float

    def logit(self, text: str) -> float:
        stats, places = features(text)
        return float((stats - self.mean) / self.scale @ self.weights + self.words[places].sum() + self.bias)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> Classifier:
    """Logistic regression by Adam over the whole sample's features."""
    x = np.stack([s for s, _ in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = (x - mean) / scale
    places = np.concatenate([p for _, p in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for _, p in rows])
    common_ones = np.bincount(places, minlength=PLACES) >= SEEN
    row, places = row[common_ones[places]], places[common_ones[places]]
    theta = np.zeros(STATS + PLACES + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        words = np.bincount(row, weights=theta[STATS:-1][places], minlength=len(rows))
        z = x @ theta[:STATS] + words + theta[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good
        grad = np.concatenate([x.T @ miss, np.bincount(places, weights=miss[row], minlength=PLACES), [miss.sum()]]) / len(rows)
        grad[:-1] += PENALTY * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    return Classifier(mean, scale, theta[:STATS], theta[STATS:-1], float(theta[-1]), float(np.log(share / (1 - share))))


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier | None:
    """Of a document of several rows the first by text counts. Features are computed in the tasks; the driver gets
    SAMPLE rows of them at most, each STATS numbers and at most PLACES places, and no text."""
    sample = _labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    held = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("quality", _places.clear)
        for rows in common.smaller(batches):
            found = [features(t) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["doc_id", "good", "stats", "places"]
            )

    one = held.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    rows = one.mapInArrow(run, "doc_id long, good int, stats array<double>, places array<long>").orderBy("doc_id").toPandas()
    good = rows.good.to_numpy(dtype=float)
    if not len(rows) or good.min() == good.max():
        return None
    return fit(list(zip(map(np.asarray, rows.stats), map(np.asarray, rows.places), strict=True)), good)


def _scored(df: DataFrame, model: Classifier, key: str, text: str, host: str, path: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("quality", _places.clear)
        for rows in common.smaller(batches):
            logits = [held.value.logit(t) if t else None for t in rows.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(logits, pa.float64())], names=["doc_id", "host", "path", "logit"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, logit double")


def _strength(groups: DataFrame, above: Column) -> float:
    """k by moments: the rates' variance about the level above, less what chance gives, sets it."""
    wide = groups.withColumn("m", above).withColumn("rate", F.col("s") / F.col("n")).withColumn("chance", F.col("m") * (1 - F.col("m")))
    spread = wide.agg(F.sum(F.col("n") * (F.col("rate") - F.col("m")) ** 2).alias("q"), F.sum("chance").alias("c"), F.sum(F.col("n") * F.col("chance")).alias("nc"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g")).first()
    if not spread.g or not spread.nc:
        return MOST_K
    between = (spread.q - spread.c) / max(1e-9, spread.n - spread.nn / spread.n if spread.g > 1 else spread.n)
    chance = spread.nc / spread.n
    return MOST_K if between <= 0 else min(MOST_K, max(LEAST_K, chance / between - 1))


def _log_odds(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(safe / (1 - safe))


def assess(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "host", path: str = "path") -> DataFrame:
    """doc_id, host, path, doc_logit, host_rate, path_rate, score, kept: one row for each of df."""
    model = train(df, labels, key, text)
    if model is None:
        return df.select(
            F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"),
            F.lit(0.0).alias("doc_logit"), F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"), F.lit(0.5).alias("score"),
            (F.coalesce(F.col(text), F.lit("")) != "").alias("kept"),
        )
    scored = common.shared_table(_scored(df, model, key, text, host, path), "scored")
    known = scored.join(_labelled(labels), "doc_id", "left").withColumn("p", F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-F.col("logit")))))
    known = known.withColumn("p", F.coalesce("p", F.lit(0.0)))
    paths = common.shared_table(known.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = common.shared_table(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(0.999, max(0.001, (total.s + 1) / (total.n + 2)))
    k_host = _strength(hosts, F.lit(mean))
    rated = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    by_path = paths.join(rated, F.col("host").eqNullSafe(F.col("h"))).withColumn("above", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host))
    k_path = _strength(by_path, F.col("above"))
    sites = by_path.select("h", F.col("path").alias("q"), F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s")
    joined = known.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_rate = (F.col("host_s") - F.col("p") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    path_rate = (F.col("path_s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("path_n") - 1 + k_path)
    told = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    evidence = F.coalesce(F.col("logit") - model.prior, F.lit(0.0))
    score = 1 / (1 + F.exp(-(evidence + _log_odds(F.col("path_rate")))))
    return told.select("doc_id", "host", "path", F.col("logit").alias("doc_logit"), "host_rate", "path_rate", score.alias("score")).withColumn("kept", (F.col("score") >= 0.5) & F.col("doc_logit").isNotNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_quality: every document; its host is its source, its path the language within."""
    documents = common.table(spark, sf_dir, "documents")
    sited = documents.select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return assess(sited, common.table(spark, sf_dir, "labels"))
