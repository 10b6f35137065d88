"""Quality, neighbours, mixing and the pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import common, lm, mixing, neighbours, quality


def rows_of(df):
    return df.collect()


# 1


def quality_docs(spark):
    random.seed(6)
    good = lambda: " ".join(random.choice("the of and house river stone green walks quietly under".split()) for _ in range(60)) + "."
    junk = lambda: " ".join(random.choice(["$$$", "###", "|", "BUY", "WIN!!!"]) for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        host = "bad.example" if bad and i % 2 else "hot.example" if i % 5 else f"site{i}.example"
        rows.append((i, junk() if bad else good(), host, f"{host}/p{i % 4}"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [(1000, None, "hot.example", None), (1001, "", None, None), rows[5]]
    labels += [(5, None, 0), (3, 1, 1), (3, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_docs(spark)
    got = rows_of(quality.assess(docs, labels))
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    held_out = [i for i in range(300) if i % 2 == 0]
    assert np.mean([by[i].kept == (i % 3 != 0) for i in held_out]) >= 0.97
    assert not by[1000].kept and not by[1001].kept
    assert all(0 <= r.score <= 1 and 0 <= r.path_rate <= 1 for r in got)


def test_rates_shrink_towards_the_level_above(spark):
    docs, labels = quality_docs(spark)
    got = rows_of(quality.assess(docs, labels))
    overall = np.mean([r.score for r in got])
    hosts = {r.host: r for r in got}
    bad, hot = hosts["bad.example"], hosts["hot.example"]
    assert bad.host_rate < hot.host_rate
    single = [r.host_rate for r in got if r.host and r.host.startswith("site")]
    assert all(abs(x - overall) < abs(bad.host_rate - overall) + 0.3 for x in single)


def test_quality_without_labels(spark):
    docs, labels = quality_docs(spark)
    got = rows_of(quality.assess(docs, labels.limit(0)))
    assert all(r.score == 0.5 and r.kept == (r.doc_id not in (1000, 1001)) for r in got)
    assert rows_of(quality.assess(docs.limit(0), labels.limit(0))) == []


# 5


def brute(rows, queries):
    fine = [(i, np.array([*v, *[0.0] * (16 - len(v))], float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for q, x in fine:
        if q % queries == 0:
            near = sorted((-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in fine if i != q)
            out[q] = near[:5]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + 0.4 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    same = r.normal(size=16).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0] * 3), (2250, []), (2201, same[:5]), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("v", F.lit("x")).repartition(5)
    got = rows_of(neighbours.search(df, F.col("id") % 50 == 0))
    want = brute(rows, 50)
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert set(by) == set(want)
    hits = total = 0
    for q, near in want.items():
        told = sorted(by[q])
        assert [k for k, _, _ in told] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in near} & {i for _, i, _ in told})
        total += 5
        if q >= 1000:
            assert [i for _, i, _ in told] == [i for _, i in near]  # ties go to smaller ids
        assert np.allclose(sorted(s for _, _, s in told), sorted(-s for s, i in sorted((x for x in near), key=lambda x: x[0])), atol=1e-2)
    assert hits / total >= 0.9


def test_no_neighbour_is_missed_on_rows_that_codewords_fit_badly(spark):
    """Tight groups about few centres, vectors of all directions, and scaled copies: what is nearest is all in the last digits."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 96))
    rows = [(i, (centres[i % 6] + 1e-4 * r.normal(size=96)).tolist()) for i in range(3000)]
    rows += [(3000 + i, r.standard_t(2, size=96).tolist()) for i in range(3000)]
    rows += [(6000 + i, (centres[0] * 2.0 ** (i % 40)).tolist()) for i in range(120)] + [(7000, (centres[1] * 1e200).tolist()), (7001, (centres[1] * 1e-200).tolist())]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for row in rows_of(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("id") % 50 == 0)):
        got.setdefault(row.query_id, {})[row.vec_id] = row.score
    for k in np.flatnonzero(ids % 50 == 0):
        near = x @ x[k]
        near[k] = -2
        assert np.allclose(sorted(got[int(ids[k])].values()), np.sort(near)[-5:], rtol=0, atol=1e-12)


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert rows_of(neighbours.search(spark.createDataFrame([], kind), F.col("id") % 50 == 0)) == []
    few = rows_of(neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], kind), F.col("id") % 50 == 0))
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]


def test_beam_is_no_worse_than_greedy():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = neighbours.train(x)
    codes, norms = q.encode(x)
    whole = sum(q.books[m][codes[:, m]] for m in range(len(q.books)))
    assert np.allclose(np.linalg.norm(whole, axis=1), norms, atol=1e-4)
    greedy = x.copy()
    for book in q.books:
        greedy = greedy - book[np.argmin((book**2).sum(axis=1) - 2 * greedy @ book.T, axis=1)]
    assert ((x - whole) ** 2).sum() <= (greedy**2).sum() + 1e-6


# 4


def test_mixing_is_a_distribution_and_learns():
    random.seed(9)
    words = [("".join(random.choice("abcd") for _ in range(random.randint(1, 4)))).encode() for _ in range(500)]
    kinds, n = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=np.int64)
    ones, every = np.zeros(mixing.FIRST[-1]), np.zeros(mixing.FIRST[-1])
    mixing.counted(words, kinds, n, ones, every)
    weights = mixing.Weights()
    weights.learn(words, kinds, n, *mixing.shrunk(ones, every))
    model = mixing.Model.of(ones, every, weights)
    singles = [bytes([b]) for b in range(256) if b != 32]
    assert sum(10.0 ** model.score(singles, np.zeros(len(singles), dtype=np.int64))) <= 1.0 + 1e-6
    known, other = model.score(words, kinds).mean(), model.score([b"zqzq"] * 5, np.zeros(5, dtype=np.int64)).mean()
    assert known > other + 1


# the pipeline


def test_pipeline_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    one = corpus_pipeline.language_id(spark, docs, sf)
    two = corpus_pipeline.near_dedup(spark, docs, sf)
    three = corpus_pipeline.decontamination(spark, docs, sf)
    four = corpus_pipeline.secret_scan(spark, docs, sf)
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns and stage.schema.simpleString() == docs.schema.simpleString()
    assert four.count() == docs.count() and two.count() < docs.count() and two.select("doc_id").distinct().count() == two.count()
    last = corpus_pipeline.run(spark, sf)
    assert last.count() <= two.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_on_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", 0), (1, "the the and of", "en", "s", 4), (1, "the the and of", "en", "s", 4), (None, "the and of by", None, None, None), (None, "the and of by", None, None, None), (2, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns and sorted((r.doc_id or -1) for r in rows_of(out)) == [-1, 1, 2]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs, sf).count() >= 1


def test_held_out_texts_score_better_than_by_token_counts(spark):
    told = lm.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg("bits_per_byte").alias("bits")).first()
    assert told.s > 0.92 * told.b and 0 < told.bits < 2.5


def test_order_and_copies_count(spark):
    """A text that training holds twice, or holds and is held out, scores better than its words shuffled; its own part is left out."""
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    texts = {i: " ".join(word() for _ in range(200)) for i in range(40)}
    texts[50] = texts[0]
    shuffled = texts[1].split()
    random.shuffle(shuffled)
    texts[51] = " ".join(shuffled)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, df, learned=F.lit(True)).collect()}
    once = np.mean([got[i].score for i in range(2, 40)])
    assert got[0].score > 0.4 * once and got[50].score > 0.4 * once
    assert abs(got[51].score - once) < 0.2 * abs(once) and got[1].score < 0.8 * once
    out = {r.doc_id: r for r in lm.score(df, df.where("doc_id < 40")).collect()}
    assert out[50].score > 0.4 * once > out[51].score


def test_an_end_is_no_byte_of_a_text(spark):
    df = spark.createDataFrame([(1, "\x00"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in lm.score(df, df).collect()}
    assert got == {1: 2, 2: 1, 3: 1} and mixing.block([b"", b"\x00"], np.zeros(2, dtype=np.int64)).word.tolist().count(0) == 8


def test_posterior_is_that_of_plain_python(spark):
    """Rates and scores against the formula, by loops over the documents."""
    docs, labels = quality_docs(spark)
    got = {(r.doc_id, r.path): r for r in rows_of(quality.assess(docs, labels))}
    worst = {}
    for r in labels.where("quality IS NOT NULL").collect():
        worst[r.doc_id] = min(worst.get(r.doc_id, 1), int(r.quality == 1 and r.toxic == 0))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    all_rows = rows_of(quality.assess(docs, labels))
    p = lambda r: float(worst[r.doc_id]) if r.doc_id in worst else sigmoid(r.doc_logit) if r.doc_logit is not None else 0.0
    host, path = {}, {}
    for r in all_rows:
        for level, k in ((host, r.host), (path, (r.host, r.path))):
            n, s = level.get(k, (0, 0.0))
            level[k] = n + 1, s + p(r)
    n, s = sum(x for x, _ in host.values()), sum(x for _, x in host.values())
    mean = (s + 1) / (n + 2)

    def strength(groups):
        q = sum(n * (s / n - m) ** 2 for n, s, m in groups)
        c, nc = sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for n, _, m in groups)
        total = sum(n for n, _, _ in groups)
        between = (q - c) / max(1e-9, total - sum(n * n for n, _, _ in groups) / total)
        return quality.MOST_K if between <= 0 else min(quality.MOST_K, max(quality.LEAST_K, nc / total / between - 1))

    k_host = strength([(n, s, mean) for n, s in host.values()])
    above = {h: (s + k_host * mean) / (n + k_host) for h, (n, s) in host.items()}
    k_path = strength([(n, s, above[h]) for (h, _), (n, s) in path.items()])
    for r in all_rows:
        (hn, hs), (pn, ps) = host[r.host], path[r.host, r.path]
        host_rate = (hs - p(r) + k_host * mean) / (hn - 1 + k_host)
        path_rate = (ps - p(r) + k_path * host_rate) / (pn - 1 + k_path)
        assert abs(r.host_rate - host_rate) < 1e-9 and abs(r.path_rate - path_rate) < 1e-9
    assert len(got) >= 300


def test_neighbours_of_the_tables_are_found(spark):
    """Recall of the registered query against all pairs, on embeddings."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in rows_of(common.table(spark, sf, "embeddings")) if r.embedding is not None]
    x = np.stack([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in rows_of(neighbours.query(spark, sf)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = n = 0
    for k in np.flatnonzero(ids % 50 == 0):
        near = x @ x[k]
        near[k] = -2
        want = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        hits, n = hits + len(want & {i for _, i in got[int(ids[k])]}), n + 5
    assert hits >= 0.9 * n
