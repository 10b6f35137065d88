"""Recognition quality and dataset operators."""

from __future__ import annotations

import random
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators import blocks as met
from gradeloom.session import shared_dir

PROBABILITIES = (0.60, 0.70, 0.80, 0.85, 0.90, 0.95, 0.98)
MARGINS = (0.0, 0.05, 0.10, 0.20)


def confusion(rows: DataFrame, labels: list) -> DataFrame:
    """A row for each expected label with counts by predicted label; labels never met have zeros."""
    wide = rows.groupBy("expected").pivot("predicted", labels).count()
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("expected"))
    return names.join(wide, "expected", "left").select("expected", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"p{x}") for x in labels])


def scores(rows: DataFrame, labels: list) -> DataFrame:
    """Support, precision, recall and F1 of each label, 0 where undefined."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    long = rows.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p")))).alias("x"), (F.col("expected") == F.col("predicted")).cast("int").alias("hit"))
    by = long.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.s")).alias("hits"))
    j = names.join(by, "label", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    told = j.withColumn("precision", share("hits", "predicted")).withColumn("recall", share("hits", "support"))
    return told.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).select("label", "support", "precision", "recall", "f1")


def averages(by_label: DataFrame) -> DataFrame:
    """Macro and support-weighted means."""
    w = F.sum("support")
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / w
    return by_label.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), mean("precision").alias("weighted_precision"), mean("recall").alias("weighted_recall"), mean("f1").alias("weighted_f1"))


def selective(rows: DataFrame, probabilities=PROBABILITIES, margins=MARGINS, null_accuracy: bool = False) -> DataFrame:
    """For each threshold of a fixed grid, how much is accepted and how much of that is right.

    The grid is a literal array exploded in each row's task; the grouping is by grid, summed in parts.
    """
    grid = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(float(m)).alias("m")) for p in probabilities for m in margins))
    hit = F.col("expected") == F.col("predicted")
    taken = (F.col("confidence") >= F.col("g.p")) & (F.col("margin") >= F.col("g.m"))
    by = rows.select("expected", "predicted", "confidence", "margin", F.explode(grid).alias("g")).groupBy(F.col("g.p").alias("probability"), F.col("g.m").alias("margin"))
    told = by.agg(F.count("*").alias("n"), F.count_if(taken).alias("accepted"), F.count_if(taken & ~hit).alias("errors"))
    none = F.lit(None).cast("double") if null_accuracy else F.lit(0.0)
    return told.select("probability", "margin", "accepted", "errors", (F.col("accepted") / F.col("n")).alias("coverage"), F.when(F.col("accepted") > 0, 1 - F.col("errors") / F.col("accepted")).otherwise(none).alias("accuracy"))


def exact_fields(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of fields (their characters in order), how many are read without error."""
    told = rows.groupBy(*keys).agg(F.bool_and(F.col("expected") == F.col("predicted")).alias("exact"), F.count("*").alias("cells"))
    return told.groupBy("cells").agg(F.count("*").alias("fields"), F.count_if("exact").alias("exact")).withColumn("rate", F.col("exact") / F.col("fields"))


def path_precision(claims: DataFrame) -> DataFrame:
    """A10: by path: claims, right ones, eligible ones, false eligible ones, rates (null on zero), and the gate."""
    right = F.col("roll") == F.col("truth")
    by = claims.groupBy("path").agg(F.count("*").alias("candidates"), F.count_if(right).alias("correct"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & ~F.coalesce(right, F.lit(False))).alias("false_eligible"))
    return by.select("*", F.when(F.col("candidates") > 0, F.col("correct") / F.col("candidates")).alias("precision"), F.when(F.col("eligible") > 0, F.col("false_eligible") / F.col("eligible")).alias("false_rate"), ((F.col("eligible") > 0) & (F.col("false_eligible") == 0)).alias("gate_passed"))


def class_weights(rows: DataFrame, labels: list, most: float = 8.0) -> DataFrame:
    """Total / (classes * count), a count of zero as one, at most 8."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    counted = names.join(rows.groupBy(F.col("expected").alias("label")).count(), "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.select("label", "n", F.least(F.lit(most), total / (len(labels) * F.greatest("n", F.lit(1)))).alias("weight"))


def exposure(test: DataFrame, catalogue: DataFrame) -> DataFrame:
    """How a test writer is known to training: seen in training, in validation, or not at all."""
    seen = catalogue.groupBy("writer").agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split") == "val").alias("v"))
    j = test.join(seen, "writer", "left")
    return j.withColumn("exposure", F.when(F.coalesce("t", F.lit(False)), "training_seen").when(F.coalesce("v", F.lit(False)), "validation_seen").otherwise("unused")).drop("t", "v")


def ensemble(members: DataFrame, weights: DataFrame) -> DataFrame:
    """M1: the digit of the greatest weighted mean (ties: the smaller). members: crop, member, scores."""
    j = members.join(weights, "member").select("crop", "weight", F.posexplode("scores").alias("digit", "s"))
    mean = j.groupBy("crop", "digit").agg((F.sum(F.col("weight") * F.floor(F.col("s") * 1e6).cast("long"))).alias("mass"))
    w = Window.partitionBy("crop").orderBy(F.desc("mass"), "digit")
    return mean.withColumn("place", F.row_number().over(w)).where("place = 1").select("crop", F.col("digit").alias("predicted"))


def knn_vote(queries: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """The label most of the k nearest have; ties go to the label of the nearest of them.

    Both sides are dealt to blocks of bounded size and only k of a meeting of two blocks go on. queries: id, q. known: known_id, x, label.
    """
    return _voted(met.nearest_of(queries, known, k))


def knn_vote_all(vectors: DataFrame, k: int = 3) -> DataFrame:
    """The vote of the k nearest others for each vector, all vectors being references. vectors: id, label, v (integers)."""
    return _voted(met.nearest(vectors, k))


def _voted(near: DataFrame) -> DataFrame:
    votes = near.groupBy("id", "label").agg(F.count("*").alias("votes"), F.min("place").alias("first"))
    best = Window.partitionBy("id").orderBy(F.desc("votes"), "first")
    return votes.withColumn("p", F.row_number().over(best)).where("p = 1").select("id", "label", "votes")


def balanced(rows: DataFrame, label: str, seed: int, target: int | None = None) -> DataFrame:
    """As many of each label as the rarest has (or the target), by seeded hash; reproducible, not a fixed shuffle."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    ranked = rows.withColumn("place", F.row_number().over(w))
    if target is not None:
        return ranked.withColumn("kept", F.col("place") <= target)
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return ranked.withColumn("kept", F.col("place") <= least)


def sheet_split(rows: DataFrame, sheet: str, last: int) -> DataFrame:
    """The last sheets in order are held out: a top list, which each task shortens first."""
    held = rows.select(sheet).distinct().orderBy(F.desc(sheet)).limit(last).withColumn("split", F.lit("val"))
    return rows.join(held, sheet, "left").fillna("train", ["split"])


def grouped_holdout(rows: DataFrame, components: DataFrame, test: int, seed: int) -> DataFrame:
    """Whole groups (linked writers and crops) go to test, by seeded hash, until the target is met.

    components: writer, group. Groups are ranked over one list of groups, which is small beside the rows.
    """
    sizes = rows.join(components, "writer").groupBy("group").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), "group"), "group")
    placed = sizes.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    splits = placed.select("group", F.when(F.col("upto") <= test, "test").otherwise("train").alias("split"))
    return rows.join(components, "writer").join(splits, "group")


def first_by_hash(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """The first row of each digest is kept; digests with several labels are conflicts."""
    w = Window.partitionBy(digest)
    told = rows.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn("labels", F.size(F.collect_set("label").over(w)))
    return told.withColumn("kept", (F.col("place") == 1) & (F.col("labels") == 1))


def leakage(rows: DataFrame, column: str) -> DataFrame:
    """Values that two splits share; none may."""
    return rows.groupBy(column).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def auto_label(m: dict[str, Column], program: Column, kind: Column) -> Column:
    """A crop's label from its ink shares, or needs_review."""
    lo, hi = F.least(m["diag1"], m["diag2"]), F.greatest(m["diag1"], m["diag2"])
    cross = (m["outer"] >= 0.11) & (m["dist"] >= 1.75) & (hi >= 0.46) & (lo >= 0.20) & (m["width"] >= 2.15) & (m["height"] >= 2.15)
    slash = (m["outer"] >= 0.15) & (m["dist"] >= 1.95) & (hi >= 0.55) & (F.greatest(m["width"], m["height"]) >= 2.45)
    empty = (m["inner"] <= 0.12) & (m["outer"] <= 0.035) & (m["dist"] <= 1.5) & (m["total"] <= 0.16)
    filled = (m["inner"] >= 0.42) & (m["outer"] <= 0.055) & (m["dist"] <= 1.55)
    return F.when(program, "needs_review").when(empty, "empty").when(filled, "filled").when(~kind.isin("mcq", "numerical"), "needs_review").when(cross | slash, "cancelled").otherwise("needs_review")


def crop_label(features: Column, program: Column, kind: Column) -> Column:
    """The label of a crop by its measured features (pixels.shapes)."""
    names = {
        "total": "total_ink_ratio", "inner": "inner_ink_ratio", "outer": "outside_circle_ink_ratio", "diag1": "diagonal_45_score", "diag2": "diagonal_135_score",
        "dist": "ink_distance_from_center_max", "width": "bounding_box_width", "height": "bounding_box_height",
    }
    return auto_label({k: features[n] for k, n in names.items()}, program, kind)


def softmax(logits: Column) -> Column:
    """M1: scores as probabilities; the greatest is taken off first, so no exponential overflows."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def blended(members: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """M1: keys and probs: the members' probabilities, weighted by validation accuracy (equally if all are 0).

    members: keys, member, probs. A crop's members are few, and are summed place by place.
    """
    total = weights.agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("total"))
    share = F.when(F.col("total") > 0, F.greatest("weight", F.lit(0.0)) / F.col("total")).otherwise(1.0 / F.col("members"))
    known = weights.join(F.broadcast(total.withColumn("members", F.lit(weights.count()))), F.lit(True)).select("member", share.alias("share"))
    parts = members.join(known, "member").select(*keys, F.posexplode(F.transform("probs", lambda p: p)).alias("at", "p"), "share")
    by = parts.groupBy(*keys, "at").agg(F.sum(F.col("p") * F.col("share")).alias("p"))
    return by.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("probs"))


def weak(probs: Column) -> Column:
    """M1: whether a read is retried: its top probability is under .86 or its margin under .18."""
    ranked = F.reverse(F.array_sort(probs))
    return (ranked[0] < 0.86) | (F.coalesce(ranked[0] - F.get(ranked, F.lit(1)), F.lit(1.0)) < 0.18)


def retried(first: Column, again: Column, labels: tuple[str, ...]) -> Column:
    """M1: a read from its probabilities and, if it was weak, those of the retry (else null).

    If both agree they are blended .65 to .35; if not, the first stands and disagreement is flagged.
    """
    at = lambda p: F.array_position(p, F.array_max(p)) - 1
    met = weak(first) & again.isNotNull()
    agree = met & (at(first) == at(again))
    row = F.when(agree, F.zip_with(first, again, lambda a, b: a * 0.65 + b * 0.35)).otherwise(first)
    label = F.get(F.array(*map(F.lit, labels)), at(row).cast("int"))
    ranked = F.reverse(F.array_sort(row))
    state = F.when(~met, "not_needed").when(agree, "contrast_retry_agreed").otherwise("contrast_retry_disagreed")
    return F.struct(
        F.when(label == "blank", "").otherwise(label).alias("digit"), label.alias("label"), ranked[0].alias("confidence"),
        (ranked[0] - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))).alias("margin"), state.alias("enhancement"), (met & ~agree).alias("disagreement"),
    )


#: Writer groups that the driver may plan a split for: sizes and labels only.
MOST_GROUPS = 200_000


def linked_writers(rows: DataFrame) -> DataFrame:
    """Writer and group: writers who share a crop (by digest) are one group, named by the least of them.

    A writer takes the least name among those it shares a crop with, round by round, until none changes.
    """
    spark = rows.sparkSession
    home = f"{shared_dir(spark)}/gradeloom-groups-{uuid.uuid4().hex}"
    pairs = rows.select("writer", "digest").distinct()
    pairs.write.parquet(f"{home}/pairs")
    pairs = spark.read.parquet(f"{home}/pairs")
    named = pairs.select("writer").distinct().withColumn("group", F.col("writer"))
    for i in range(1000):
        least = pairs.join(named, "writer").groupBy("digest").agg(F.min("group").alias("least"))
        after = named.join(pairs.join(least, "digest").groupBy("writer").agg(F.min("least").alias("least")), "writer").select("writer", F.col("least").alias("group"), (F.col("least") != F.col("group")).alias("moved"))
        after.write.parquet(f"{home}/round{i}")
        named = spark.read.parquet(f"{home}/round{i}")
        if named.where("moved").isEmpty():
            return named.drop("moved")
        named = named.drop("moved")
    raise RuntimeError("groups did not settle")


def _chosen(sizes: dict[str, int], target: int, seed: int) -> set[str]:
    """Whole groups whose rows come nearest to the target (less rather than more), in a seeded order.

    Reachable sums are the bits of a number; sums beyond twice the target (or the least group) are no
    nearer than nothing, so memory is bounded by the target: a group's place for each sum it first reached.
    """
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    whole = sum(sizes.values())
    most = min(whole - 1, max(2 * target, min(sizes.values(), default=0)))
    if most < 1:
        raise ValueError("too few independent writers for the split")
    by = np.full(most + 1, -1, dtype=np.int32)
    reach, mask = 1, (1 << (most + 1)) - 1
    for i, group in enumerate(order):
        new = (reach << sizes[group]) & ~reach & mask
        if new:
            reach |= new
            bits = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
            by[np.flatnonzero(bits[: most + 1])] = i
    sums = np.flatnonzero(by >= 0)
    if not len(sums):
        raise ValueError("too few independent writers for the split")
    at, out = int(min(sums, key=lambda t: (abs(int(t) - target), t))), set()
    while at:
        out.add(order[by[at]])
        at -= sizes[order[by[at]]]
    return out


def linked_holdout(rows: DataFrame, test: int, validation: int, seed: int = 557, trials: int = 32) -> DataFrame:
    """Rows with group and split: writers who share crops stay together; sums of whole groups meet the targets.

    Of the trials for validation the one nearest to its target counts, then the one that lacks the fewest
    labels. The driver plans over groups (their number is checked), never over rows. rows: writer, digest, label, ...
    """
    groups = linked_writers(rows)
    told = rows.join(groups, "writer")
    by = told.groupBy("group").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"))
    if by.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of writers")
    listed = by.collect()
    sizes, labels = {r.group: r.n for r in listed}, {r.group: set(r.labels) for r in listed}
    if test < 1 or validation < 1 or test + validation >= sum(sizes.values()):
        raise ValueError("the targets must leave rows to train on")
    held = _chosen(sizes, test, seed)
    rest = {g: n for g, n in sizes.items() if g not in held}
    every = set().union(*(labels[g] for g in rest))
    best = None
    for trial in range(trials):
        some = _chosen(rest, validation, seed + 1 + trial)
        score = (abs(sum(rest[g] for g in some) - validation), len(every - set().union(*(labels[g] for g in some))))
        if best is None or score < best[0]:
            best = score, some
        if score == (0, 0):
            break
    split = rows.sparkSession.createDataFrame([(g, "test" if g in held else "val" if g in best[1] else "train") for g in sizes], f"group {rows.schema['writer'].dataType.simpleString()}, split string")
    return told.join(split, "group")
