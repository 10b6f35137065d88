"""Operator 11: a Merkle manifest of a dataset, by superblock reduction.

A row is a leaf: H of its columns in order, each ``-`` if null, else its UTF-8 byte count, ``:``
and its value. H is the lowercase hex SHA-256, of digests as hex text. The leaves of one group
(lang) ascend by key (doc_id); while nodes remain, every FANOUT consecutive ones become their H.
What remains is the group's root; the groups' roots, in their order, likewise give the root of all.

Nodes are numbered within their tree by a range sort and the row counts of its partitions, so no
group, however large, is in one task. A bucket is all nodes of one tree whose numbers agree
but for the last LEVELS digits to the base FANOUT: at most FANOUT ** LEVELS rows. ``applyInPandas``
collapses a bucket's LEVELS levels into one node; these are the next round's nodes, until one is
left in each tree. Proofs come down the same rounds: a bucket's nodes meet the proof of its root
in a cogroup, and a leaf's proof is the lower part from its bucket followed by the upper one. Each
round's nodes are a table in the shared folder, so a lost task reads its bucket again.

Rows that are alike in key are ordered by their digest; equal rows are equal leaves, each counted.
A null key comes first in its group, a null group before all others. A group of one leaf is that
leaf. No rows: no trees. Columns other than those named take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FANOUT, LEVELS = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of digests to a task when they are numbered.
NUMBERED = 1 << 20


def h(*parts: Column) -> Column:
    """H of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's byte count, a colon and the value."""
    held = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(held).cast("string"), F.lit(":"), held), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(df: DataFrame, columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None) -> Column:
    """The leaf of each row, with some columns' values changed."""
    return h(*[field((changed or {}).get(c, F.col(c))) for c in columns])


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _hash(digests: bytes) -> bytes:
    return hashlib.sha256(digests.hex().encode()).digest()


def collapsed(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> list[list[bytes]]:
    """The nodes and each of the levels above them."""
    every = [nodes]
    for _ in range(levels):
        below = every[-1]
        every.append([_hash(b"".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return every


def siblings(every: list[list[bytes]], at: int, fanout: int = FANOUT) -> bytes:
    """A node's proof: for each level the number of siblings, its own place, and the siblings' digests."""
    found = []
    for level in every[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        found.append(bytes((len(run) - 1, at - first)) + b"".join(run[: at - first] + run[at - first + 1 :]))
        at //= fanout
    return b"".join(found)


def steps(proof: bytes) -> list[tuple[int, bytes]]:
    """A proof's levels from below: the place and the siblings."""
    found, at = [], 0
    while at < len(proof):
        to = at + 2 + 32 * proof[at]
        found.append((proof[at + 1], proof[at + 2 : to]))
        at = to
    return found


def folded(node: bytes, proof: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and the siblings of its proof give."""
    for place, others in proof:
        node = _hash(others[: 32 * place] + node + others[32 * place :])
    return node


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with idx, their number in their tree by the order, and n, the tree's number of rows.

    A range sort deals the rows; a tree's rows in one partition begin after those of it in the
    partitions before.
    """
    parts = max(1, -(-rows.count() // NUMBERED))
    kept = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    dealt = common.shared_table(kept.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "numbered")
    runs = dealt.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = runs.groupBy(tree).agg(F.sort_array(F.collect_list(F.struct("part", "first", "rows"))).alias("runs"), F.sum("rows").alias("n"))
    sums = F.aggregate("runs", F.expr("cast(array(0) as array<bigint>)"), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["rows"])))
    place = before.withColumn("sums", sums).select(tree, "n", F.posexplode("runs").alias("k", "run"), "sums").select(tree, "n", F.col("run.part").alias("part"), (F.get("sums", F.col("k")) - F.col("run.first")).alias("shift"))
    return dealt.join(place, [tree, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


NODES = "tree string, idx long, n long, digest binary"


def _raised(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One round: the root of each bucket as a node of the next."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows.n.iloc[0])
        up = min(levels, height(n, fanout))
        top = collapsed(rows.digest.tolist(), up, fanout)[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // fanout**up)], "digest": top})

    return nodes.groupBy("tree", F.expr(f"idx div {fanout**levels}").alias("bucket")).applyInPandas(run, NODES)


def raised(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of every round, the last with one for each tree."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        rounds.append(common.shared_table(_raised(rounds[-1], fanout, levels), "nodes"))
        most = -(-most // fanout**levels)
    return rounds


def _met(nodes: DataFrame, tops: DataFrame, give: Callable, schema: str | T.StructType, fanout: int, levels: int) -> DataFrame:
    """give(rows of a bucket by idx, their lower proofs, the bucket root's row) for each bucket."""

    def run(key: tuple, rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        every = collapsed(rows.digest.tolist(), min(levels, height(int(rows.n.iloc[0]), fanout)), fanout)
        return give(rows, [siblings(every, i, fanout) for i in range(len(rows))], top.iloc[0])

    bucket = F.expr(f"idx div {fanout**levels}").alias("bucket")
    return nodes.groupBy("tree", bucket).cogroup(tops.groupBy("tree", F.col("idx").alias("bucket"))).applyInPandas(run, schema)


PROVEN = "tree string, idx long, proof binary, subroot binary, root binary"


def lowered_proofs(rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The proofs of the nodes of the second round, from those of the last. tops: as PROVEN."""

    def give(rows: pd.DataFrame, lower: list[bytes], top: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": rows.tree, "idx": rows.idx, "proof": [x + top.proof for x in lower], "subroot": top.subroot, "root": top.root})

    for nodes in reversed(rounds[1:-1]):
        tops = common.shared_table(_met(nodes, tops, give, PROVEN, fanout, levels), "proofs")
    return tops


def manifest(
    df: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    columns: tuple[str, ...] = COLUMNS,
    tampered: dict[str, Column] | None = None,
    where: Column | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    tampered: columns' values as they are found when the rows are checked, of the rows where the
    condition holds (all, if there is none); the others' are as they were.
    """
    found = leaves(df, columns, tampered)
    found = F.when(where, found) if where is not None else found
    tree = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))
    dug = df.select(F.col(key).alias("key"), tree.alias("tree"), F.unhex(leaves(df, columns)).alias("digest"), (F.unhex(found) if tampered else F.lit(None).cast("binary")).alias("found"))
    rows = common.shared_table(numbered(common.shared_table(dug, "leaves"), "tree", ["key", "digest"]), "leaves")

    rounds = raised(rows.select("tree", "idx", "n", "digest"), fanout, levels)
    subroots = rounds[-1].select(F.col("tree").alias("lang"), "digest")
    over = common.shared_table(numbered(subroots.withColumn("tree", F.lit("")), "tree", ["lang"]), "subroots")
    above = raised(over.select("tree", "idx", "n", "digest"), fanout, levels)
    root = above[-1].select("tree", "idx", F.expr("cast('' as binary)").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    if len(above) > 1:
        root = _met(over.select("tree", "idx", "n", "digest", "lang"), lowered_proofs(above, root, fanout, levels), _named, f"lang string, {PROVEN}", fanout, levels)
    else:
        root = root.join(over.select("tree", "idx", "lang", "digest"), ["tree", "idx"]).select("lang", "tree", "idx", "proof", F.col("digest").alias("subroot"), "root")
    tops = root.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", "subroot", "root")
    tops = lowered_proofs(rounds, common.shared_table(tops, "proofs"), fanout, levels)

    def give(rows: pd.DataFrame, lower: list[bytes], top: pd.Series) -> pd.DataFrame:
        upper = steps(top.proof)
        above = b"".join(x for _, x in upper).hex()
        ends: dict[bytes, bytes] = {}
        proofs, roots = [], []
        for digest, other, low in zip(rows.digest, rows.found, lower, strict=True):
            below = steps(low)
            proofs.append(hashlib.sha256((b"".join(x for _, x in below).hex() + above).encode()).hexdigest())
            at = folded(digest if other is None else other, below)
            if at not in ends:
                ends[at] = folded(at, upper)
            roots.append(ends[at])
        return pd.DataFrame(
            {key: rows.key, "leaf": [x.hex() for x in rows.digest], "subroot": top.subroot.hex(), "root": top.root.hex(), "proof_sha256": proofs, "folded_root": [x.hex() for x in roots], "verified": [x == top.root for x in roots]}
        )

    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *texts, T.StructField("verified", T.BooleanType())])
    return _met(rows, tops, give, schema, fanout, levels)


def _named(rows: pd.DataFrame, lower: list[bytes], top: pd.Series) -> pd.DataFrame:
    """The groups' roots with their proofs."""
    return pd.DataFrame({"lang": rows.lang, "tree": rows.tree, "idx": rows.idx, "proof": [x + top.proof for x in lower], "subroot": rows.digest, "root": top.root})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_merkle: every document's leaf and proof; every third (by crc32 of its id) is checked with its text in lower case."""
    documents = common.table(spark, sf_dir, "documents")
    third = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    return manifest(documents, tampered={"text": lowered(F.col("text"))}, where=third)


def _levels_sql(nodes: str, rows: str, levels: int, place: str, out: str) -> str:
    """Relations that raise the nodes (tree, idx, n, digest) and fold the rows (row, tree, idx, held, proof) level by level."""
    text = f"{out}n0 AS (SELECT tree, idx, n, digest FROM {nodes}), {out}p0 AS (SELECT row, tree, idx, held, proof FROM {rows})"
    for k in range(levels):
        text += f""", {out}r{k} AS (SELECT tree, idx // {FANOUT} AS idx, any_value(n) AS n, list(digest ORDER BY idx) AS run FROM {out}n{k} GROUP BY 1, 2),
 {out}n{k + 1} AS (SELECT tree, idx, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {out}r{k}),
 {out}p{k + 1} AS (SELECT p.row, p.tree, r.idx, CASE WHEN n > 1 THEN sha256(array_to_string(run[:p.idx % {FANOUT}], '') || held || array_to_string(run[p.idx % {FANOUT} + 2:], '')) ELSE held END AS held,
 proof || array_to_string(run[:p.idx % {FANOUT}], '') || array_to_string(run[p.idx % {FANOUT} + 2:], '') AS proof FROM {out}p{k} p JOIN {out}r{k} r ON p.tree = r.tree AND p.idx // {FANOUT} = r.idx)"""
    return text


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql(levels: int = 7, groups: int = 3) -> str:
    """SQL for the query, of up to FANOUT ** levels documents a language and FANOUT ** groups languages."""
    leaf = lambda text: "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in COLUMNS) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH crc_of AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc),
 ids AS (SELECT DISTINCT doc_id AS id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents, crc_of WHERE doc_id IS NOT NULL),
 dug AS (SELECT row_number() OVER () AS row, d.doc_id, coalesce('=' || lang, '-') AS tree, {leaf("text")} AS leaf, CASE WHEN i.crc % 3 = 0 THEN {leaf(small)} ELSE {leaf("text")} END AS held FROM documents d LEFT JOIN ids i ON doc_id = id),
 leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest, '' AS proof FROM dug),
 {_levels_sql("leaf", "leaf", levels, "doc_id", "a")},
 tops AS (SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest FROM an{levels}),
 ends AS (SELECT p.row, t.tree, t.idx, p.held, p.proof FROM ap{levels} p JOIN tops t ON p.tree = t.lang),
 {_levels_sql("tops", "ends", groups, "lang", "b")}
SELECT l.doc_id, l.leaf, t.digest AS subroot, r.digest AS root, sha256(p.proof) AS proof_sha256, p.held AS folded_root, p.held = r.digest AS verified
 FROM leaf l JOIN tops t ON l.tree = t.lang JOIN bp{groups} p ON l.row = p.row, bn{groups} r"""


SQL = _sql()
