"""Operator 3: near-duplicate documents by bottom-k sketches from one hash function.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit
   fingerprint of the set and the k least hash values (the sketch). Documents of equal sets
   are one class; only classes go on.
2. Inverted lists: values that no two classes retain are dropped. Two sets as similar as
   asked share at least c of k retained values (below), so, with each sketch ordered by how
   many classes retain a value, rarest first, they share one of the first k - c + 1. Only
   these are in lists; a passage that a third of all documents hold is in none but those of
   documents that hold little else.
3. In each list, members are compared with a hub (that with the fewest values of its own)
   and with the next in that order; pairs that pass the union-sketch estimate are verified
   on the full sets. A tight group is one component after this, without all its pairs.
4. Classes in lists that still hold several components get larger sketches (LARGE values,
   for most the full set) and new lists, in which c is close to the true bound. So copies
   that differ from each other in too much are in no list together, however many they are.
   In each list, members outside its largest component are compared with all members of
   other components, which leaves no pair between components unexamined; a pair is made in
   the first list that both are in, and only if enough of either's values come there or
   later.
5. Components of the verified links, by stars (``components``).

c: of the k least values of the union of two sets with Jaccard similarity 0.85, each is
shared with probability 0.85, drawn without replacement. c is 5.2 standard deviations below
the mean, so a pair at the very threshold is missed with probability under 1e-6, and any
more similar one far less; for sets that the sketch holds whole the bound is certain.

Null or empty texts, and those without words, have no shingles and are linked with nothing.
Rows of one doc_id are one document. A null doc_id is linked with nothing: its component_id
is null and it is kept. Ties (equal sets) go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import distinct, forget, overlap

#: Values in a sketch, and in a larger one.
K, LARGE = 32, 256
#: Members of a list that are ordered in one task; a longer list is dealt into parts.
PART = 4096
#: Members of a list outside its largest component that one task compares with the list's others.
SALTED = 1024

SCAN = "doc_id long, n_shingles long, fp binary, sketch array<long>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, fp (fingerprint of the set) and sketch (its k least values, ascending)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("shingles", forget_sets)
        for rows in common.smaller(batches):
            sizes, prints, sketches = [], [], []
            for value in rows.column(1).to_pylist():
                found = distinct(common.words(value))
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append((found[:K] >> 1).astype("int64"))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fp", "sketch"],
            )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCAN)


def _least_shared(n: Column, k: int) -> Column:
    """How many values the sketch of a set of this size shares at least with that of a similar set."""
    union = n / 0.85
    without = F.greatest(F.lit(0.0), (union - k) / F.greatest(F.lit(1.0), union - 1))
    drawn = 0.85 * k - 5.2 * F.sqrt(k * 0.85 * 0.15 * without)
    return F.when(union <= k, F.ceil(n * 85 / 100.0)).otherwise(F.floor(F.least(n * 0.85, drawn))).cast("int")


def _alike(a: Column, b: Column, n_a: Column, n_b: Column, k: int) -> Column:
    """The union-sketch estimate: of the k least values of the union, how many are in both.

    Of sets that the sketches hold whole this is how many values they share.
    """
    both = F.array_intersect(a, b)
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.when(F.greatest(n_a, n_b) <= k, F.size(both)).otherwise(F.size(F.array_intersect(least, both)))
    return shared >= _needed(n_a, n_b, k)


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * 85


def kept_size(n: Column, k: int) -> Column:
    return F.least(n, F.lit(k)).cast("int")


def _needed(n_a: Column, n_b: Column, k: int) -> Column:
    """How many values the sketches of two similar sets share at least, by both sizes."""
    whole = F.greatest(n_a, n_b) <= k
    return F.when(whole, F.ceil((n_a + n_b) * 85 / 185.0)).otherwise(F.least(_least_shared(n_a, k), _least_shared(n_b, k)))


def inverted_lists(sketches: DataFrame, k: int) -> DataFrame:
    """v, members, node, n, alone, first, left: for each retained value the classes that may be similar by it.

    sketches: node, n, sketch (k values at most). alone: how many of its values the class has by itself.
    first: all values by which the class is in lists, in the order of all classes. left: how many of its
    values come at v or later in that order.
    """
    held = sketches.select("node", "n", F.explode("sketch").alias("v"))
    counts = held.groupBy("v").agg(F.count("*").alias("members")).where("members > 1")
    shared = held.join(counts, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("members", "v"))).alias("values"))
    kept = kept_size(F.col("n"), k)
    alone = kept - F.size("values")
    number = F.greatest(F.lit(0), kept - _least_shared(F.col("n"), k) + 1 - alone)
    listed = shared.select("node", "n", alone.alias("alone"), F.slice("values", F.lit(1), number).alias("x"))
    spread = listed.select("node", "n", "alone", F.col("x.v").alias("first"), (kept_size(F.col("n"), k) - F.col("alone")).alias("shared"), F.posexplode("x").alias("at", "x"))
    return spread.select("x.v", "x.members", "node", "n", "alone", "first", (F.col("shared") - F.col("at")).alias("left"))


def _near_pairs(lists: DataFrame) -> DataFrame:
    """a, b: each member with its part's hub and with the next in order; hubs with their list's first."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / PART))
    dealt = lists.select("v", "members", "node", "n", "alone", part.alias("part"))
    order = Window.partitionBy("v", "part").orderBy("alone", "n", "node")
    own = F.struct("node", "n")
    hub, beside = F.first(own).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lag(own).over(order)
    seen = dealt.select("node", "n", hub.alias("hub"), beside.alias("beside"))
    within = seen.select("node", "n", F.explode(F.array("hub", "beside")).alias("to"))
    hubs = dealt.where(F.col("members") > PART).groupBy("v", "part").agg(F.min(F.struct("alone", "n", "node")).alias("h"))
    top = hubs.groupBy("v").agg(F.min("h").alias("top"))
    across = hubs.join(top, "v").select(F.col("h.node").alias("node"), F.col("h.n").alias("n"), F.struct(F.col("top.node").alias("node"), F.col("top.n").alias("n")).alias("to"))
    pairs = within.unionByName(across).where(F.col("to").isNotNull() & (F.col("to.node") != F.col("node")) & _sizes_fit(F.col("n"), F.col("to.n")))
    return pairs.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    own = nodes.select("node", "n", "sketch")
    a, b = own.toDF("a", "n_a", "sketch_a"), own.toDF("b", "n_b", "sketch_b")
    return pairs.join(a, "a").join(b, "b").where(_alike(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), K)).select("a", "b")


@lru_cache(maxsize=64)
def _set_of(text: str):
    return distinct(common.words(text))


def forget_sets() -> None:
    _set_of.cache_clear()
    forget()


def verified(pairs: DataFrame, texts: DataFrame, percent: int = 85) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    texts: doc_id, text. Each row that comes to Python holds two texts, so memory is bounded by a batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("shingles", forget_sets)
        for rows in common.smaller(batches):
            ends = zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)
            keep = []
            for s, t in ends:
                x, y = _set_of(s), _set_of(t)
                both = overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def _several(lists: DataFrame, component: DataFrame) -> DataFrame:
    """The lists' rows, with each one's component and its list's largest, of lists with several components."""
    named = lists.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = named.groupBy("v", "component").agg(F.count("*").alias("size"))
    largest = per.groupBy("v").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return named.join(largest.select("v", F.col("top.component").alias("top")), "v")


def _larger(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, sketch: sketches of LARGE values of the wanted nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("shingles", forget_sets)
        for rows in common.smaller(batches):
            found = [distinct(common.words(t)) for t in rows.column(1).to_pylist()]
            sketches = [(x[:LARGE] >> 1).astype("int64") for x in found]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["node", "n", "sketch"])

    return texts.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "node long, n long, sketch array<long>")


def _rest_pairs(lists: DataFrame, larger: DataFrame, component: DataFrame) -> DataFrame:
    """a, b: pairs of a list between components, by the estimate from larger sketches, which is made
    within the join, so only pairs that pass become rows; one end is outside the list's largest component."""
    mixed = _several(lists, component).join(larger.select("node", "sketch"), "node")
    # of a long list each one of one side meets all of the other, in one of several tasks
    shares = F.ceil(F.col("members") / SALTED).cast("int")
    x = mixed.where("component <> top").select("v", F.pmod(F.xxhash64("node"), shares).cast("int").alias("salt"), F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("component").alias("c_x"), F.col("sketch").alias("s_x"), F.col("first").alias("f_x"), F.col("left").alias("l_x"))
    y = mixed.select("v", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"), F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("component").alias("c_y"), F.col("sketch").alias("s_y"), F.col("first").alias("f_y"), F.col("left").alias("l_y"), (F.col("component") == F.col("top")).alias("in_top"))
    fits = (F.col("c_x") != F.col("c_y")) & (F.col("in_top") | (F.col("x") < F.col("y"))) & _sizes_fit(F.col("n_x"), F.col("n_y"))
    # lists are in one order for all classes, so a pair is made in the first that both are in
    once = F.get(F.array_intersect("f_x", "f_y"), F.lit(0)) == x.v
    # what two sets share comes at their first common value or later
    enough = F.least("l_x", "l_y") >= _needed(F.col("n_x"), F.col("n_y"), LARGE)
    found = x.join(y, (x.v == y.v) & (x.salt == y.salt) & fits & enough & once & _alike(F.col("s_x"), F.col("s_y"), F.col("n_x"), F.col("n_y"), LARGE))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of df."""
    scanned = common.shared_table(scan(df, key, text), "scan")
    able = scanned.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = common.shared_table(classes, "classes")
    lists = common.shared_table(inverted_lists(nodes, K), "lists")
    every = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # only texts of classes in lists are needed from here on: shuffled whole once, and kept
    texts = common.shared_table(every.join(lists.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    common.release(df.sparkSession)

    near = common.shared_table(verified(_estimated(_near_pairs(lists), nodes), texts), "links")
    common.release(df.sparkSession)
    grouped = components(near)
    open_lists = _several(lists, grouped).select("node").distinct()
    larger = common.shared_table(_larger(texts, open_lists).dropDuplicates(["node"]), "sketches")
    common.release(df.sparkSession)
    relisted = common.shared_table(inverted_lists(larger, LARGE), "lists")
    rest = common.shared_table(verified(_rest_pairs(relisted, larger, grouped), texts), "links")
    common.release(df.sparkSession)
    # a document of several texts ties their classes together by its id
    ties = scanned.where("doc_id IS NOT NULL AND n_shingles > 0").join(nodes.select("fp", "node"), "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    ends = grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest).unionByName(ties)
    final = components(ends)
    return (
        scanned.select("doc_id", "n_shingles")
        .join(final, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_minhash: every document with its component."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
