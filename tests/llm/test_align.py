"""Alignment of two tokenizers against a plain per-document computation by their libraries."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gradeloom.llm import align

SCHEMA = "doc_id long, text string, row string, codes string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(align.A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.B)
    return a, b, align.spelled_by_a(a), align.spelled_by_b(b)


def groups_of(text, libraries):
    """Lists of (A ids, B ids)."""
    a, b, a_bytes, b_bytes = libraries
    if not text:
        return []
    sides = [(a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)]
    if any(b"".join(table[i] for i in ids) != (" " + text).encode() for ids, table in sides):
        return []
    ends = []
    for ids, table in sides:
        at, own = 0, []
        for i in ids:
            at += len(table[i])
            own.append(at)
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, before = [], 0
    for cut in cuts:
        out.append(tuple([i for i, e in zip(ids, own) if before < e <= cut] for (ids, _), own in zip(sides, ends)))
        before = cut
    return out


def spelled(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def expected(rows, libraries):
    every = [(r[0], groups_of(r[1], libraries)) for r in rows]
    links = [Counter((a, b) for g in groups for a in g[0] for b in g[1]) for _, groups in every]
    counts = Counter(p for found in links for p in found)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc, groups), found in zip(every, links):
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(found.values()),
            sum(t for p, t in found.items() if counts[p] == best[p[0]]), sum(t * counts[p] for p, t in found.items()),
            hashlib.sha256(spelled(groups).encode()).hexdigest() if groups else "",
        ))
    return out


key = lambda x: tuple(map(str, x))

TEXTS = [
    None, "", " ", "  ", "a", "a  b", " lead", "trail ", "two  spaces and\nlines\n\nmore\t tabs \r\n", "one▁two", "<|endoftext|> and <s> as text", "Ünïcode größe 日本語の文章 🙂🙂 naïve",
    "é   nbsp em", "don't we'll I'M", "x" * 3000, "0123456789" * 400, "\x00\x01 zero", "ＦＵＬＬ ﬁ ligature", "mixed   runs    of     spaces", "end\n",
]


def made():
    pick = random.Random(4)
    words = "the of Haus rivière piedra green walks quietly under 3.14 http://x.example/a?b=1 ... AKIA99ZZ -- naïvely überall".split()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(pick.choice(words) for _ in range(pick.randrange(1, 60)))) for i in range(80)]
    rows += [(101, rows[21][1]), (None, "a null id here"), (None, "a null id here")]
    rows.append((500, " ".join(pick.choice(words) + pick.choice(["", "", "\n", "  "]) for _ in range(6000))))
    rows.append((501, "".join(pick.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000))))
    return [(*r, "clash", "clash") for r in rows]


def got(df, **more):
    return sorted((tuple(r) for r in align.summaries(df, **more).collect()), key=key)


def test_summaries_are_those_of_the_libraries(spark, libraries):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
    want = sorted(expected(rows, libraries), key=key)
    assert [x[:5] for x in got(df)] == [x[:5] for x in want]
    assert got(df) == want


def test_bounds_change_nothing(spark, libraries, monkeypatch):
    """Short stretches, small batches, no pair looked up, every group large and every document loose."""
    rows = made()[:60] + made()[-2:]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(expected(rows, libraries), key=key)
    assert got(df, hot=0, stretch=64) == want
    assert got(df, hot=200) == want


@pytest.mark.parametrize(("small", "large", "held", "bytes_"), [(1, 2, 1 << 20, 200), (4, 1 << 16, 10, 100), (256, 1 << 16, 1 << 20, 50)])
def test_sweep_by_parts(libraries, monkeypatch, small, large, held, bytes_):
    """The machine alone, fed with few events at a time."""
    import numpy as np

    monkeypatch.setattr(align, "SMALL", small)
    monkeypatch.setattr(align, "LARGE", large)
    monkeypatch.setattr(align, "HELD", held)
    both = align.tokens(align.A, align.B)
    rows = made()
    stream = []
    for n, (doc, text, *_) in enumerate(rows):
        for side, (ids, ends) in enumerate(both.encode([text or ""])):
            offsets = np.cumsum(both.lengths[side][ids])
            for s in range(int(offsets[-1] - 1) // 64 + 1 if len(ids) else 1 - side):
                some = ids[(offsets - 1) // 64 == s] if len(ids) else ids
                stream.append((n, doc, s, side, some.astype("<u2").tobytes()))
    stream.sort(key=lambda x: (x[0], x[2], x[3]))
    sweep, at = align.Sweep(both, whole=True), 0
    while at < len(stream):
        to, size = at, 0
        while to < len(stream) and (size < bytes_ or to == at):
            size += len(stream[to][4])
            to += 1
        part = stream[at:to]
        sweep.feed(np.array([x[0] for x in part]), [x[1] for x in part], np.array([x[3] for x in part]), [x[4] for x in part])
        at = to
    sweep.end()
    out = sweep.taken()
    whole = {x[0]: x for x in out if not x[2]}
    pairs = {}
    for x in out:
        found = pairs.setdefault(x[0], Counter())
        for c, t in zip(np.frombuffer(x[10], "<i8").tolist(), np.frombuffer(x[11], "<i8").tolist()):
            found[divmod(c, 32000)] += t
    for n, (_, text, *_) in enumerate(rows):
        groups = groups_of(text, libraries)
        assert whole[n][9] == spelled(groups)
        assert pairs[n] == Counter((a, b) for g in groups for a in g[0] for b in g[1])
        assert whole[n][3] or not any(x[2] for x in out if x[0] == n)


def test_groups_and_links(spark, libraries):
    rows = made()[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, align.groups(df).collect()), key=key) == sorted(((r[0], spelled(groups_of(r[1], libraries))) for r in rows), key=key)
    found = {}
    for r in align.links(df.where("doc_id >= 20")).collect():
        found.setdefault(r.doc_id, {})[r.a, r.b] = r.times
    for r in rows[20:]:
        assert found.get(r[0], {}) == Counter((a, b) for g in groups_of(r[1], libraries) for a in g[0] for b in g[1])


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    zeros = got(spark.createDataFrame([(1, None, "", ""), (2, "", "", "")], SCHEMA))
    assert zeros == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, sf, libraries):
    out = entry.queries()["op13_align"](spark, sf)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", "string")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(expected(rows, libraries), key=key)
    assert out.agg(F.sum("n_links")).first()[0] > 0
