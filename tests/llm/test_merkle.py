"""The Merkle manifest against a plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(nodes, fanout):
    """The root, and for each node the siblings of every level by place."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % fanout
            paths[i].append((k - first, nodes[first : first + fanout]))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return (nodes[0] if nodes else ""), paths


def expected(rows, fanout):
    order = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((order(r.doc_id), leaf_of(r, r.text), r))
    trees = [(lang, sorted(groups[lang], key=lambda x: x[:2])) for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode()))]
    tops = [climb([leaf for _, leaf, _ in rows], fanout) for _, rows in trees]
    root, above = climb([t[0] for t in tops], fanout)
    out = []
    for (_, members), (subroot, paths), over in zip(trees, tops, above):
        for (_, leaf, r), path in zip(members, paths):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            small = r.text if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            node, sibs = leaf_of(r, small) if tampered else leaf, ""
            for place, run in path + over:
                sibs += "".join(run[:place] + run[place + 1 :])
                node = h("".join(run[:place] + [node] + run[place + 1 :]))
            out.append((r.doc_id, leaf, subroot, root, h(sibs), node, node == root))
    return out


def got(df, **more):
    third = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    return [tuple(r) for r in merkle.manifest(df, tampered={"text": merkle.lowered(F.col("text"))}, where=third, **more).collect()]


def rows(n, seed=3):
    pick = random.Random(seed)
    made = [(i if i % 9 else None, pick.choice([None, "", "Some Text", "plain", "ÄÖ Upper é" * 3, "X" * 200_000]), pick.choice([None, "en", "en", "en", "de", "é"]), pick.choice([None, "web"]), pick.choice([None, i]), "clash") for i in range(n)]
    return made + made[:3]


@pytest.mark.parametrize(("n", "fanout", "levels"), [(0, 8, 3), (1, 8, 3), (9, 2, 2), (75, 2, 3), (200, 3, 1), (150, 8, 3)])
def test_proofs_are_those_of_a_plain_tree(spark, n, fanout, levels):
    df = spark.createDataFrame(rows(n) if n else [], SCHEMA)
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(got(df, fanout=fanout, levels=levels), key=key) == sorted(expected(df.collect(), fanout), key=key)


def test_single_rows_of_languages(spark):
    df = spark.createDataFrame([(1, "A", "en", None, 1, ""), (2, "b", None, None, 1, "")], SCHEMA)
    assert sorted(got(df)) == sorted(expected(df.collect(), 8))


def test_numbers_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "NUMBERED", 16)
    df = spark.createDataFrame(rows(120), SCHEMA).repartition(7)
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(got(df, fanout=2, levels=2), key=key) == sorted(expected(df.collect(), 2), key=key)


def test_query(spark, sf):
    out = entry.queries()["op11_merkle"](spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), *((c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", "boolean")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, out.collect())) == sorted(expected(docs, 8))
    assert any(not r.verified for r in out.collect())
