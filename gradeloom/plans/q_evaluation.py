"""Queries on evaluation, datasets, written answers, markers, exports, layout and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import scalars as P
from gradeloom.operators import evaluation as E
from gradeloom.operators import grading as G
from gradeloom.operators import release as K
from gradeloom.plans import adapters as A
from gradeloom.plans.q_grading import GRADED, graded

Q, S = {}, {}
LABELS = list(range(11))


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


LABELS_SQL = ", lab AS (SELECT CAST(l AS INTEGER) AS label FROM range(11) t(l))"
ONE = LABELS_SQL + ", one AS (SELECT * FROM predictions WHERE member = 0)"
BY = ONE + """, by_label AS (SELECT label, coalesce(support, 0) AS support, CASE WHEN pred > 0 THEN hits / pred ELSE 0.0::DOUBLE END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0::DOUBLE END AS recall
 FROM lab LEFT JOIN (SELECT expected AS label, count(*) AS support, count(*) FILTER (expected = predicted) AS hits FROM one GROUP BY 1) USING (label) LEFT JOIN (SELECT predicted AS label, count(*) AS pred FROM one GROUP BY 1) USING (label)),
 full_by AS (SELECT label, support, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, CASE WHEN coalesce(precision, 0) + coalesce(recall, 0) > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM by_label)
"""


def one(spark, d):
    return A.predictions(spark, d).where("member = 0")


@query("confusion_matrix", A.sql("predictions", ONE + "SELECT label AS expected, " + ", ".join(f"count(*) FILTER (predicted = {x}) AS p{x}" for x in LABELS) + " FROM lab LEFT JOIN one ON expected = label GROUP BY label"))
def _(spark, d):
    return E.confusion(one(spark, d), LABELS)


@query("precision_recall_f1", A.sql("predictions", BY + "SELECT label, CAST(support AS BIGINT) AS support, precision, recall, f1 FROM full_by"))
def _(spark, d):
    return E.scores(one(spark, d), LABELS)


def rounded(df, *columns):
    return df.select(*[(F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c) for c in columns])


@query("macro_weighted_f1", A.sql("predictions", BY + "SELECT " + ", ".join(f"floor(({x}) * 1e9 + 0.5) / 1e9 AS {n}" for x, n in [("avg(precision)", "macro_precision"), ("avg(recall)", "macro_recall"), ("avg(f1)", "macro_f1"), ("sum(precision * support) / sum(support)", "weighted_precision"), ("sum(recall * support) / sum(support)", "weighted_recall"), ("sum(f1 * support) / sum(support)", "weighted_f1")]) + " FROM full_by"))
def _(spark, d):
    a = E.averages(E.scores(one(spark, d), LABELS))
    return rounded(a, *a.columns)


GRID = ", grid AS (SELECT p, m FROM (VALUES " + ", ".join(f"({p}::DOUBLE)" for p in E.PROBABILITIES) + ") a(p), (VALUES " + ", ".join(f"({m}::DOUBLE)" for m in E.MARGINS) + ") b(m))"


@query("selective_accuracy", A.sql("predictions", GRID + ", t AS (SELECT p, m, count(*) AS n, count(*) FILTER (confidence >= p AND margin >= m) AS accepted, count(*) FILTER (confidence >= p AND margin >= m AND expected <> predicted) AS errors FROM predictions, grid GROUP BY 1, 2) SELECT p AS probability, m AS margin, accepted, errors, accepted / n AS coverage, CASE WHEN accepted > 0 THEN 1 - errors / accepted ELSE 0.0::DOUBLE END AS accuracy FROM t"))
def _(spark, d):
    return E.selective(A.predictions(spark, d))


@query("selective_accuracy_compared", A.sql("predictions", ", t AS (SELECT p, count(*) AS n, count(*) FILTER (confidence >= p) AS accepted, count(*) FILTER (confidence >= p AND expected <> predicted) AS errors FROM predictions, (VALUES (0.80::DOUBLE), (0.90::DOUBLE), (0.95::DOUBLE), (0.999::DOUBLE)) g(p) GROUP BY 1) SELECT p AS probability, accepted, errors, accepted / n AS coverage, CASE WHEN accepted > 0 THEN 1 - errors / accepted END AS accuracy FROM t"))
def _(spark, d):
    return E.selective(A.predictions(spark, d), (0.80, 0.90, 0.95, 0.999), (0.0,), null_accuracy=True).drop("margin")


@query("exact_roll_accuracy", A.sql("predictions", ", f AS (SELECT crop, count(*) AS cells, bool_and(expected = predicted) AS exact FROM predictions GROUP BY crop) SELECT cells, count(*) AS fields, count(*) FILTER (exact) AS exact, count(*) FILTER (exact) / count(*) AS rate FROM f GROUP BY cells"))
def _(spark, d):
    return E.exact_fields(A.predictions(spark, d), ["crop"], "member")


@query("member_comparison", A.sql("predictions", "SELECT member, CASE WHEN writer % 3 = 0 THEN 'training_seen' WHEN writer % 3 = 1 THEN 'validation_seen' ELSE 'unused' END AS exposure, count(*) AS n, count(*) FILTER (expected = predicted) AS correct FROM predictions GROUP BY 1, 2"))
def _(spark, d):
    p = A.predictions(spark, d)
    catalogue = p.where("writer % 3 < 2").select("writer", F.when(F.col("writer") % 3 == 0, "train").otherwise("val").alias("split")).distinct()
    return E.exposure(p, catalogue).groupBy("member", "exposure").agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("predicted")).alias("correct"))


@query("exposure_audit", A.sql("predictions", "SELECT DISTINCT writer, CASE WHEN writer % 3 = 0 THEN 'training_seen' WHEN writer % 3 = 1 THEN 'validation_seen' ELSE 'unused' END AS exposure FROM predictions"))
def _(spark, d):
    w = A.predictions(spark, d).select("writer").distinct()
    return E.exposure(w, w.where("writer % 3 < 2").select("writer", F.when(F.col("writer") % 3 == 0, "train").otherwise("val").alias("split")))


@query("path_precision", "SELECT path, count(*) AS candidates, count(*) FILTER (ok) AS correct, count(*) FILTER (el) AS eligible, count(*) FILTER (el AND NOT ok) AS false_eligible, CASE WHEN count(*) > 0 THEN count(*) FILTER (ok) / count(*) END AS precision, CASE WHEN count(*) FILTER (el) > 0 THEN count(*) FILTER (el AND NOT ok) / count(*) FILTER (el) END AS false_rate, count(*) FILTER (el) > 0 AND count(*) FILTER (el AND NOT ok) = 0 AS gate_passed FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS path, o_orderkey % 7 <> 0 AS ok, o_orderkey % 3 = 1 AND o_orderkey % 14 <> 0 AND o_orderkey % 5 < 2 AS el FROM orders) GROUP BY path")
def _(spark, d):
    k = F.col("o_orderkey")
    claims = A.table(spark, d, "orders").select(F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C").alias("path"), F.lit("r").alias("roll"), F.when(k % 7 != 0, "r").otherwise("x").alias("truth"), ((k % 3 == 1) & (k % 14 != 0) & (k % 5 < 2)).alias("eligible"))
    return E.path_precision(claims)


@query("reason_grouping_sets", "SELECT o_orderstatus AS reason, CAST(o_orderkey % 3 AS BIGINT) AS page, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderkey % 3), ())")
def _(spark, d):
    A.table(spark, d, "orders").createOrReplaceTempView("gradeloom_orders")
    return spark.sql("SELECT reason, page, count(*) AS n, min(o_totalprice) AS least FROM (SELECT o_orderstatus AS reason, o_orderkey % 3 AS page, o_totalprice FROM gradeloom_orders) GROUP BY GROUPING SETS ((reason), (page), ())")


@query("class_count_cube", A.sql("predictions", "SELECT CASE WHEN writer % 5 = 0 THEN 'val' ELSE 'train' END AS split, expected AS label, count(*) AS n, count(DISTINCT writer) AS writers FROM predictions GROUP BY CUBE (1, 2)"))
def _(spark, d):
    p = A.predictions(spark, d).withColumn("split", F.when(F.col("writer") % 5 == 0, "val").otherwise("train"))
    return p.cube("split", F.col("expected").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("writer").alias("writers"))


@query("class_weights", A.sql("predictions", LABELS_SQL + ", c AS (SELECT label, count(expected) AS n FROM lab LEFT JOIN predictions ON expected = label GROUP BY 1) SELECT label, n, least(8.0::DOUBLE, (SELECT sum(n) FROM c) / (11 * greatest(n, 1))) AS weight FROM c"))
def _(spark, d):
    return E.class_weights(A.predictions(spark, d), LABELS)


@query("epoch_metrics", A.sql("predictions", LABELS_SQL + "SELECT label, member, CASE WHEN count(expected) > 0 THEN count(*) FILTER (expected = predicted) / count(expected) END AS accuracy FROM lab CROSS JOIN range(4) m(member) LEFT JOIN predictions p ON p.expected = label AND p.member = m.member GROUP BY ALL".replace("SELECT label, member,", " SELECT label, m.member,")))
def _(spark, d):
    p = A.predictions(spark, d)
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("label")).select("label", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("member"))
    by = p.groupBy(F.col("expected").alias("label"), F.col("member").cast("long").alias("member")).agg(F.avg((F.col("expected") == F.col("predicted")).cast("int")).alias("accuracy"))
    return names.join(by, ["label", "member"], "left")


@query("round_trip_stats", A.sql("bubbles", "SELECT q_no, count(*) FILTER (fill >= 0.5) AS recovered, min(fill) FILTER (fill >= 0.5) AS least_filled, max(fill) FILTER (fill < 0.5) AS most_empty, min(fill) FILTER (fill >= 0.5) - max(fill) FILTER (fill < 0.5) AS separation FROM bubbles GROUP BY q_no"))
def _(spark, d):
    full, empty = F.when(F.col("fill") >= 0.5, F.col("fill")), F.when(F.col("fill") < 0.5, F.col("fill"))
    return A.bubbles(spark, d).groupBy("q_no").agg(F.count(full).alias("recovered"), F.min(full).alias("least_filled"), F.max(empty).alias("most_empty"), (F.min(full) - F.max(empty)).alias("separation"))


@query("ensemble_argmax", A.sql("predictions", ", m AS (SELECT crop, digit, sum((member + 1) * CAST(floor(CAST(s AS DOUBLE) * 1e6) AS BIGINT)) AS mass FROM (SELECT crop, member, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS digit FROM predictions) GROUP BY 1, 2) SELECT crop, CAST(digit AS INTEGER) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY mass DESC, digit) AS place FROM m) WHERE place = 1"))
def _(spark, d):
    weights = spark.createDataFrame([(i, i + 1) for i in range(4)], "member int, weight long")
    p = A.predictions(spark, d).withColumn("scores", F.col("scores").cast("array<double>"))
    return E.ensemble(p, weights)


@query("knn_vote", "WITH e AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: floor(CAST(x AS DOUBLE) * 1000)) AS v FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.vec_id AS id, b.label, b.vec_id AS known_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM e a JOIN e b ON a.vec_id % 10 = 3 AND b.vec_id % 10 = 1), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, known_id) AS place FROM p), v AS (SELECT id, label, count(*) AS votes, min(place) AS first FROM n WHERE place <= 3 GROUP BY 1, 2) SELECT id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first) AS p FROM v) WHERE p = 1")
def _(spark, d):
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 1000)).alias("v"))
    queries = e.where("vec_id % 10 = 3").select(F.col("vec_id").alias("id"), F.col("v").alias("q"))
    known = e.where("vec_id % 10 = 1").select("label", F.col("vec_id").alias("known_id"), F.col("v").alias("x"))
    return E.knn_vote(queries, known)


@query("knn_vote_all")
def _(spark, d):
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    return E.knn_vote_all(e.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("v")))


@query("hash_dedup", "SELECT doc_id, place = 1 AND labels = 1 AS kept FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS place, count(DISTINCT lang) OVER (PARTITION BY sha256(text)) AS labels FROM documents)")
def _(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("lang").alias("label"))
    return E.first_by_hash(docs, "digest", "doc_id").select("doc_id", "kept")


@query("sheet_split", A.sql("responses", "SELECT split, count(*) AS n, count(DISTINCT sheet) AS sheets FROM (SELECT sheet, CASE WHEN dense_rank() OVER (ORDER BY sheet DESC) <= 100 THEN 'val' ELSE 'train' END AS split FROM responses) GROUP BY 1"))
def _(spark, d):
    return E.sheet_split(A.responses(spark, d).select("sheet", "q_no"), "sheet", 100).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("sheet").alias("sheets"))


@query("balanced_sample")
def _(spark, d):
    rows = A.predictions(spark, d).where("member = 0").select(F.col("crop").alias("id"), "expected")
    return E.balanced(rows, "expected", 557).where("kept").select("id", "expected")


@query("grouped_holdout")
def _(spark, d):
    rows = A.predictions(spark, d).where("member = 0").select("crop", "writer", "expected")
    groups = rows.select("writer").distinct().withColumn("group", F.col("writer") % 12)
    return E.grouped_holdout(rows, groups, 100, 557).select("crop", "writer", "group", "split")


@query("linked_holdout_groups", "WITH RECURSIVE w AS (SELECT DISTINCT CAST(vec_id % 61 AS VARCHAR) AS writer, CAST(vec_id % 400 AS VARCHAR) AS digest FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 61 < 40 AND vec_id % 400 < 350), e AS (SELECT DISTINCT a.writer AS a, b.writer AS b FROM w a JOIN w b USING (digest)), r(writer, grp) AS (SELECT writer, writer FROM w UNION SELECT e.b, r.grp FROM r JOIN e ON e.a = r.writer) SELECT writer, min(grp) AS grp FROM r GROUP BY writer")
def _(spark, d):
    return E.linked_writers(writers(spark, d)).select("writer", F.col("group").alias("grp"))


def writers(spark, d):
    k = F.col("vec_id")
    rows = A.table(spark, d, "embeddings").where("embedding IS NOT NULL AND vec_id % 61 < 40 AND vec_id % 400 < 350")
    return rows.select(k.alias("crop"), (k % 61).cast("string").alias("writer"), (k % 400).cast("string").alias("digest"), F.col("label").cast("string").alias("label"))


@query("linked_holdout")
def _(spark, d):
    k = F.col("vec_id")
    rows = A.table(spark, d, "embeddings").select(k.alias("crop"), (k % 61).cast("string").alias("writer"), k.cast("string").alias("digest"), F.col("label").cast("string").alias("label"))
    return E.linked_holdout(rows, 20, 10)


@query("ensemble_softmax", A.sql("predictions", ", x AS (SELECT crop, member, list_transform(scores, lambda s: exp(CAST(s AS DOUBLE) - CAST(list_max(scores) AS DOUBLE))) AS e FROM predictions), p AS (SELECT crop, member, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x), m AS (SELECT crop, digit, sum(v * (member + 1) / 10.0) AS p FROM (SELECT crop, member, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS digit FROM p) GROUP BY 1, 2), k AS (SELECT crop, digit, p, row_number() OVER (PARTITION BY crop ORDER BY p DESC, digit) AS place FROM m) SELECT a.crop, CAST(a.digit AS INTEGER) AS digit, floor(a.p * 1e6 + 0.5) / 1e6 AS confidence, floor((a.p - b.p) * 1e6 + 0.5) / 1e6 AS margin, a.p < 0.86 OR a.p - b.p < 0.18 AS weak FROM k a JOIN k b USING (crop) WHERE a.place = 1 AND b.place = 2"))
def _(spark, d):
    p = A.predictions(spark, d).select("crop", "member", E.softmax(F.transform("scores", lambda x: x.cast("double"))).alias("probs"))
    weights = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "member int, weight double")
    r = E.blended(p, weights, ["crop"]).select("crop", "probs", E.retried(F.col("probs"), F.lit(None).cast("array<double>"), tuple(map(str, range(11)))).alias("r"))
    near = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return r.select("crop", F.col("r.digit").cast("int").alias("digit"), near("r.confidence").alias("confidence"), near("r.margin").alias("margin"), E.weak(F.col("probs")).alias("weak"))


@query("retry_blend", "WITH x AS (SELECT p_partkey, (p_size % 40 + 40) / 100.0::DOUBLE AS a, CASE WHEN p_partkey % 3 = 0 THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END AS b FROM part), y AS (SELECT *, greatest(a, 1 - a) < 0.86 OR abs(2 * a - 1) < 0.18 AS weak, a >= 0.5 AS one, b >= 0.5 AS two FROM x), z AS (SELECT *, CASE WHEN weak AND one = two THEN a * 0.65::DOUBLE + b * 0.35::DOUBLE ELSE a END AS p FROM y) SELECT p_partkey, CASE WHEN p >= 0.5 THEN '7' ELSE '' END AS digit, floor(greatest(p, 1 - p) * 1e6 + 0.5) / 1e6 AS confidence, CASE WHEN NOT weak THEN 'not_needed' WHEN one = two THEN 'contrast_retry_agreed' ELSE 'contrast_retry_disagreed' END AS enhancement, weak AND one <> two AS disagreement FROM z")
def _(spark, d):
    a = (F.col("p_size") % 40 + 40) / F.lit(100.0)
    b = F.when(F.col("p_partkey") % 3 == 0, 0.2).otherwise(0.9)
    r = A.table(spark, d, "part").select("p_partkey", E.retried(F.array(a, 1 - a), F.array(b, 1 - b), ("7", "blank")).alias("r"))
    return r.select("p_partkey", "r.digit", (F.floor(F.col("r.confidence") * 1e6 + 0.5) / 1e6).alias("confidence"), "r.enhancement", "r.disagreement")


@query("member_confusion", A.sql("predictions", "SELECT member, expected, predicted, count(*) AS n FROM predictions GROUP BY ALL"))
def _(spark, d):
    """Each member's confusions, all members and rows."""
    return A.predictions(spark, d).groupBy("member", "expected", "predicted").agg(F.count("*").alias("n"))


@query("split_leakage", A.sql("predictions", "SELECT writer, count(DISTINCT split) AS splits FROM (SELECT writer, CASE WHEN crop % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM predictions) GROUP BY 1 HAVING count(DISTINCT split) > 1"))
def _(spark, d):
    return E.leakage(A.predictions(spark, d).withColumn("split", F.when(F.col("crop") % 5 == 0, "val").otherwise("train")), "writer")


@query("field_groups", A.sql("responses", "SELECT sheet, count(*) AS cells, string_agg(CAST(value % 10 AS VARCHAR), '' ORDER BY q_no) AS labels FROM responses GROUP BY sheet HAVING count(*) IN (5, 7)"))
def _(spark, d):
    r = A.responses(spark, d).groupBy("sheet").agg(F.count("*").alias("cells"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("q_no", "value"))), lambda x: (x["value"] % 10).cast("string")), "").alias("labels"))
    return r.where("cells IN (5, 7)")


@query("crop_auto_label", """SELECT p_partkey, CASE WHEN k % 19 = 0 THEN 'needs_review' WHEN inn <= 0.12 AND outr <= 0.035 AND dist <= 1.5 AND tot <= 0.16 THEN 'empty' WHEN inn >= 0.42 AND outr <= 0.055 AND dist <= 1.55 THEN 'filled' WHEN k % 23 = 0 THEN 'needs_review'
 WHEN (outr >= 0.11 AND dist >= 1.75 AND greatest(d1, d2) >= 0.46 AND least(d1, d2) >= 0.20 AND w >= 2.15 AND h >= 2.15) OR (outr >= 0.15 AND dist >= 1.95 AND greatest(d1, d2) >= 0.55 AND greatest(w, h) >= 2.45) THEN 'cancelled' ELSE 'needs_review' END AS label
 FROM (SELECT p_partkey, p_partkey AS k, (p_partkey % 10) / 20.0::DOUBLE AS inn, (p_partkey % 7) / 35.0::DOUBLE AS outr, 1 + (p_partkey % 13) / 10.0::DOUBLE AS dist, (p_partkey % 11) / 40.0::DOUBLE AS tot, (p_partkey % 17) / 20.0::DOUBLE AS d1, (p_partkey % 6) / 8.0::DOUBLE AS d2, 2 + (p_partkey % 5) / 8.0::DOUBLE AS w, 2 + (p_partkey % 9) / 12.0::DOUBLE AS h FROM part)""")
def _(spark, d):
    k = F.col("p_partkey")
    m = {"inner": (k % 10) / 20, "outer": (k % 7) / 35, "dist": 1 + (k % 13) / 10, "total": (k % 11) / 40, "diag1": (k % 17) / 20, "diag2": (k % 6) / 8, "width": 2 + (k % 5) / 8, "height": 2 + (k % 9) / 12}
    return A.table(spark, d, "part").select("p_partkey", E.auto_label(m, k % 19 == 0, F.when(k % 23 == 0, "roll").otherwise("mcq")).alias("label"))


# written answers and markers


WRITTEN = """, packet AS (SELECT o_custkey AS student_key, o_orderkey % 3 + 1 AS q_no, max(o_orderkey) AS ord FROM orders GROUP BY 1, 2), mk AS (SELECT o_custkey AS student_key, o_orderkey % 3 + 1 AS q_no, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS DOUBLE) END AS marks, o_orderkey % 8 = 0 AS flag, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) AS place FROM orders WHERE o_orderkey % 4 <> 3),
applied AS (SELECT p.student_key, p.q_no, 10.0::DOUBLE AS max_marks, m.marks, CASE WHEN m.marks IS NULL THEN 'pending' WHEN m.marks < 0 OR m.marks > 10 THEN 'error' WHEN coalesce(flag, FALSE) THEN 'needs_review' ELSE 'graded' END AS status FROM packet p LEFT JOIN (SELECT * FROM mk WHERE place = 1) m USING (student_key, q_no))
"""


def applied(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("student_key"), (F.col("o_orderkey") % 3 + 1).alias("q_no"), "o_orderkey")
    packet = o.groupBy("student_key", "q_no").agg(F.lit(10.0).alias("max_marks"))
    k = F.col("o_orderkey")
    marks = o.where(k % 4 != 3).select("student_key", "q_no", F.when(k % 6 != 0, (k % 12).cast("double")).alias("marks"), (k % 8 == 0).alias("flag"), k.alias("row_no"))
    return G.apply_marks(packet, marks, ["student_key", "q_no"])


@query("manual_marks_apply", "WITH _x AS (SELECT 1)" + WRITTEN + "SELECT * FROM applied")
def _(spark, d):
    return applied(spark, d).select("student_key", "q_no", "max_marks", "marks", "status")


@query("final_scores", "WITH _x AS (SELECT 1)" + WRITTEN + """, w AS (SELECT student_key, sum(marks) FILTER (status = 'graded') AS written_score, sum(max_marks) AS written_total, CASE WHEN bool_or(status = 'pending') THEN 'pending' WHEN bool_or(status <> 'graded') THEN 'needs_review' ELSE 'complete' END AS status FROM applied GROUP BY 1), ob AS (SELECT c_custkey AS student_key, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 20 AS DOUBLE) END AS objective_score FROM customer WHERE c_custkey % 13 <> 0)
 SELECT student_key, written_score, written_total, status, objective_score, CASE WHEN status = 'complete' THEN written_score + objective_score END AS total_score FROM w LEFT JOIN ob USING (student_key)""")
def _(spark, d):
    k = F.col("c_custkey")
    objective = A.table(spark, d, "customer").where(k % 13 != 0).select(k.alias("student_key"), F.when(k % 4 != 0, (k % 20).cast("double")).alias("score"))
    return G.final_scores(applied(spark, d), objective, "student_key")


@query("written_grade_checks", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'max_mismatch' WHEN o_orderkey % 12 > 10 THEN 'out_of_range' END AS error, o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS needs_review FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select("o_orderkey", F.when(k % 9 == 0, 11.0).otherwise(10.0).alias("max_marks"), F.lit(10.0).alias("request_max"), F.when(k % 6 != 0, k % 12).cast("double").alias("marks"), F.when(k % 5 == 0, "low").otherwise("high").alias("confidence"), F.when(k % 7 == 0, "").otherwise("x").alias("justification"))
    return G.validate_written(rows).select("o_orderkey", "error", "needs_review")


@query("mock_grade", "SELECT p_partkey, round(p_size * 0.5::DOUBLE, 4) AS marks, 'low' AS confidence, TRUE AS review FROM part")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", G.mock_grade(F.col("p_size").cast("double")).alias("marks"), F.lit("low").alias("confidence"), F.lit(True).alias("review"))


@query("ta_split", A.sql("roster", "SELECT roll_no, marker, CAST(floor(floor((rn - 1) / 3.0::DOUBLE) / 10) AS BIGINT) + 1 AS batch FROM (SELECT roll_no, rn, CAST((rn - 1) % 3 AS BIGINT) AS marker FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY roll_no) AS rn FROM roster))"))
def _(spark, d):
    return K.packets(A.roster(spark, d), "split", 3, 10).select("roll_no", F.col("marker").cast("long").alias("marker"), "batch")


@query("ta_double", A.sql("roster", "SELECT roll_no, CAST(m AS INTEGER) AS marker, CAST(floor((rn - 1) / 25.0::DOUBLE) AS BIGINT) + 1 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY roll_no) AS rn FROM roster), range(2) t(m)"))
def _(spark, d):
    return K.packets(A.roster(spark, d), "double", 2, 25).select("roll_no", "marker", "batch")


@query("packet_batches", A.sql("roster", "SELECT centre, CAST(floor((rn - 1) / 25.0::DOUBLE) AS BIGINT) + 1 AS batch, count(*) AS n, min(roll_no) AS first, max(roll_no) AS last FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY roll_no) AS rn FROM roster) GROUP BY 1, 2"))
def _(spark, d):
    return K.packets(A.roster(spark, d), "double", 1, 25).groupBy("centre", "batch").agg(F.count("*").alias("n"), F.min("roll_no").alias("first"), F.max("roll_no").alias("last"))


@query("packet_skips", A.sql("pages", "SELECT source_index, CASE WHEN state NOT IN ('verified', 'F') THEN 'Ownership awaiting approval' WHEN sheet_page > 2 THEN 'Question page missing' WHEN n <> 1 THEN 'Source ownership is missing or disputed' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY student_key, sheet_page) AS n FROM pages)"))
def _(spark, d):
    from pyspark.sql import Window

    p = A.pages(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("student_key", "sheet_page")))
    return p.select("source_index", K.skip_reason(F.when(F.col("state") == "F", "approved").otherwise("pending"), F.col("sheet_page") <= 2, F.col("n")).alias("reason"))


@query("ta_agreement", """WITH r AS (SELECT o_custkey AS student_key, o_orderkey % 2 AS q_no, list_distinct(list('m' || o_orderkey % 3)) AS required FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey AS student_key, o_orderkey % 2 AS q_no, list_distinct(list('m' || o_orderkey % 3)) AS given, count(DISTINCT o_orderkey % 4) AS vals, min(CAST(o_orderkey % 4 AS DOUBLE)) AS mark FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2)
 SELECT student_key, q_no, CASE WHEN len(list_filter(required, lambda x: NOT list_contains(coalesce(given, []), x))) > 0 THEN 'awaiting_marks' WHEN vals = 1 THEN 'complete' ELSE 'disagreement' END AS status, CASE WHEN len(list_filter(required, lambda x: NOT list_contains(coalesce(given, []), x))) = 0 AND vals = 1 THEN mark END AS mark FROM r LEFT JOIN g USING (student_key, q_no)""")
def _(spark, d):
    k = F.col("o_orderkey")
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("student_key"), (k % 2).alias("q_no"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("marker"), (k % 4).cast("double").alias("marks"), k.alias("k"))
    return G.combine_markers(o.where("k % 5 <> 0"), o.select("student_key", "q_no", "marker"), ["student_key", "q_no"])


RANGES = "SELECT s_nationkey % 5 AS q_no, s_suppkey AS marker, s_suppkey % 17 * 10 AS first, s_suppkey % 17 * 10 + s_suppkey % 9 * 2 AS last, s_suppkey % 6 = 0 AS additional FROM supplier"


def ranges(spark, d):
    k = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("q_no"), k.alias("marker"), (k % 17 * 10).alias("first"), (k % 17 * 10 + k % 9 * 2).alias("last"), (k % 6 == 0).alias("additional"))


@query("ta_range_overlap", f"WITH r AS ({RANGES}) SELECT a.q_no, a.marker AS a, b.marker AS b FROM r a JOIN r b ON a.q_no = b.q_no AND a.marker < b.marker AND a.first <= b.last AND b.first <= a.last AND NOT a.additional AND NOT b.additional")
def _(spark, d):
    return K.range_overlaps(ranges(spark, d))


@query("position_catalogue", A.sql("roster", "SELECT roll_no, centre, row_number() OVER (PARTITION BY centre ORDER BY roll_no) AS position FROM roster QUALIFY position BETWEEN 3 AND 12"))
def _(spark, d):
    from pyspark.sql import Window

    r = A.roster(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("centre").orderBy("roll_no")).cast("long"))
    return r.where("position BETWEEN 3 AND 12").select("roll_no", "centre", "position")


# exports


@query("answer_summary_union", A.sql("responses answer_key", GRADED + "SELECT sheet, q_no, 'MCQ' AS kind, coalesce(selected, '') AS response, CASE WHEN dropped THEN 'Dropped' ELSE CAST(awarded AS INTEGER) || '/' || CAST(marks AS INTEGER) END AS marks_text FROM graded UNION ALL SELECT sheet, q_no, 'NUMERIC', CAST(value AS VARCHAR), CASE WHEN dropped THEN 'Dropped' ELSE '0/1' END FROM graded"))
def _(spark, d):
    g = graded(spark, d)
    return K.answer_rows(g, g.withColumn("awarded", F.lit(0.0)).withColumn("marks", F.lit(1.0)))


@query("marks_export", A.sql("responses answer_key", GRADED + "SELECT sheet, coalesce(CASE WHEN sheet % 9 = 0 THEN 5.0::DOUBLE END, score) AS score, total, review_flags AS flags FROM scores"))
def _(spark, d):
    t = G.totals(graded(spark, d), ["sheet"])
    return t.select("sheet", F.coalesce(F.when(F.col("sheet") % 9 == 0, 5.0), F.col("score")).alias("score"), "total", F.col("review_flags").alias("flags"))


@query("email_bodies", A.sql("roster", "SELECT student_key, 'Dear ' || name || ', roll ' || roll_no || ': see CS301.' AS body FROM roster"))
def _(spark, d):
    fields = {"name": F.col("name"), "roll_no": F.col("roll_no"), "exam": F.lit("CS301")}
    return A.roster(spark, d).select("student_key", K.rendered("Dear {name}, roll {roll_no}: see {exam}.", fields, ("name", "roll_no", "exam")).alias("body"))


@query("review_report_union", A.sql("roster pages", "SELECT 'student' AS entity, roll_no AS id, program, NULL::INTEGER AS page, NULL AS error FROM roster UNION ALL SELECT 'unmatched', CAST(source_index AS VARCHAR), NULL, sheet_page, NULL FROM pages WHERE bubble_roll IS NULL UNION ALL SELECT 'error', CAST(source_index AS VARCHAR), NULL, NULL, quality FROM pages WHERE quality <> 'ready'"))
def _(spark, d):
    p = A.pages(spark, d)
    return K.report(
        A.roster(spark, d).select(F.lit("student").alias("entity"), F.col("roll_no").alias("id"), "program"),
        p.where("bubble_roll IS NULL").select(F.lit("unmatched").alias("entity"), F.col("source_index").cast("string").alias("id"), F.col("sheet_page").alias("page")),
        p.where("quality <> 'ready'").select(F.lit("error").alias("entity"), F.col("source_index").cast("string").alias("id"), F.col("quality").alias("error")),
    )


@query("source_union_tagged", "SELECT 'documents' AS source_dataset, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM documents UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark")
def _(spark, d):
    parts = [A.table(spark, d, t).select(F.lit(t).alias("source_dataset"), "text") for t in ("documents", "conversations", "benchmark")]
    return K.report(*parts).groupBy("source_dataset").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))


@query("unmatched_preview", A.sql("pages", "SELECT p.source_index, e.event_type AS preview FROM pages p LEFT JOIN events e ON e.event_id = p.source_index WHERE p.bubble_roll IS NULL"))
def _(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_id").alias("source_index"), F.col("event_type").alias("preview"))
    return A.pages(spark, d).where("bubble_roll IS NULL").join(e, "source_index", "left").select("source_index", "preview")


@query("priority_selection", A.sql("pages", ", u AS (SELECT source_index, min(pr) AS pr FROM (SELECT source_index, 0 AS pr FROM pages WHERE bubble_roll IS NULL UNION ALL SELECT source_index, 1 FROM pages WHERE quality <> 'ready') GROUP BY 1) SELECT source_index, CASE WHEN place > 40 THEN 'held_out' ELSE 'tuning' END AS split FROM (SELECT *, row_number() OVER (ORDER BY pr, source_index) AS place FROM u) WHERE place <= 50"))
def _(spark, d):
    from pyspark.sql import Window

    p = A.pages(spark, d)
    u = p.where("bubble_roll IS NULL").select("source_index", F.lit(0).alias("pr")).unionByName(p.where("quality <> 'ready'").select("source_index", F.lit(1).alias("pr")))
    first = u.groupBy("source_index").agg(F.min("pr").alias("pr")).orderBy("pr", "source_index").limit(50)
    w = Window.partitionBy(F.lit(0)).orderBy("pr", "source_index")
    return first.withColumn("place", F.row_number().over(w)).select("source_index", F.when(F.col("place") > 40, "held_out").otherwise("tuning").alias("split"))


@query("rubric_coverage", A.sql("responses", "SELECT coalesce(r.q_no, k.q) AS q_no, CASE WHEN k.q IS NULL THEN 'missing' WHEN r.q_no IS NULL THEN 'extra' ELSE 'covered' END AS status FROM (SELECT DISTINCT q_no FROM responses) r FULL JOIN (SELECT CAST(p_partkey AS INTEGER) AS q FROM part WHERE p_partkey BETWEEN 3 AND 12) k ON r.q_no = k.q"))
def _(spark, d):
    from gradeloom.operators.review import reconcile

    rubric = A.table(spark, d, "part").where("p_partkey BETWEEN 3 AND 12").select(F.col("p_partkey").cast("int").alias("q_no"))
    r = reconcile(A.responses(spark, d).select("q_no"), rubric, "q_no")
    return r.select("q_no", F.when(F.col("status") == "missing", "missing").when(F.col("status") == "unexpected", "extra").otherwise("covered").alias("status"))


@query("question_catalogue", "SELECT CAST(p_partkey AS INTEGER) AS q_no, 'mcq' AS kind, 1.0::DOUBLE AS marks FROM part WHERE p_partkey <= 20 UNION ALL SELECT CAST(p_partkey AS INTEGER), 'numerical', CAST(p_size AS DOUBLE) FROM part WHERE p_partkey BETWEEN 21 AND 30")
def _(spark, d):
    p = A.table(spark, d, "part").withColumn("q_no", F.col("p_partkey").cast("int"))
    mcq = p.where("p_partkey <= 20").select("q_no", F.lit("mcq").alias("kind"), F.lit(1.0).alias("marks"))
    return mcq.unionByName(p.where("p_partkey BETWEEN 21 AND 30").select("q_no", F.lit("numerical").alias("kind"), F.col("p_size").cast("double").alias("marks"))).orderBy("q_no")


@query("manifest_subset", A.sql("responses pages", "SELECT DISTINCT q_no, q_no % 3 + 1 AS page FROM responses WHERE q_no % 3 + 1 IN (SELECT sheet_page FROM pages WHERE sheet_page < 3)"))
def _(spark, d):
    q = A.responses(spark, d).select("q_no", (F.col("q_no") % 3 + 1).alias("page")).distinct()
    return q.join(A.pages(spark, d).where("sheet_page < 3").select(F.col("sheet_page").alias("page")).distinct(), "page", "left_semi").select("q_no", "page")


# layout


@query("grid_centers", "SELECT s_suppkey AS grid, CAST(place AS INTEGER) AS place, CAST(digit AS INTEGER) AS digit, CAST(s_suppkey % 50 AS DOUBLE) + CASE WHEN s_suppkey % 2 = 0 THEN place * 6.5::DOUBLE ELSE digit * 5.5::DOUBLE END AS cx_mm, CAST(s_suppkey % 70 AS DOUBLE) + CASE WHEN s_suppkey % 2 = 0 THEN digit * 5.5::DOUBLE ELSE place * 6.5::DOUBLE END AS cy_mm FROM supplier, range(7) a(place), range(10) b(digit) WHERE place < s_suppkey % 5 + 3")
def _(spark, d):
    k = F.col("s_suppkey")
    g = A.table(spark, d, "supplier").select(k.alias("grid"), (k % 5 + 3).cast("int").alias("positions"), (k % 50).cast("double").alias("x_mm"), (k % 70).cast("double").alias("y_mm"), F.lit(5.5).alias("digit_pitch_mm"), F.lit(6.5).alias("position_pitch_mm"), F.when(k % 2 == 0, "vertical").otherwise("horizontal").alias("orientation"))
    return K.grid_centres(g)


@query("mcq_layout", "SELECT exam, q_no, CAST(pg + 1 AS INTEGER) AS page, CAST(floor(a / r) AS INTEGER) AS \"column\", CAST(a % r AS INTEGER) AS \"row\" FROM (SELECT exam, q_no, pg, i % 40 AS a, CAST(ceil(least(40, n - pg * 40) / 3.0::DOUBLE) AS BIGINT) AS r FROM (SELECT p_size AS exam, p_partkey AS q_no, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p_size) AS n, CAST(floor((row_number() OVER w - 1) / 40.0::DOUBLE) AS BIGINT) AS pg FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)))")
def _(spark, d):
    items = A.table(spark, d, "part").select(F.col("p_size").alias("exam"), F.col("p_partkey").alias("q_no"))
    return K.column_major(items, 40, 3)


BOXES = "SELECT s_nationkey AS page, s_suppkey AS id, s_suppkey * 7 % 100 AS x1, s_suppkey * 7 % 100 + 20 AS x2, s_suppkey * 11 % 100 AS y1, s_suppkey * 11 % 100 + 20 AS y2 FROM supplier"


@query("box_overlap", f"WITH b AS ({BOXES}) SELECT a.page, a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
def _(spark, d):
    k = F.col("s_suppkey")
    return K.overlaps(A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("page"), k.alias("id"), (k * 7 % 100).alias("x1"), (k * 7 % 100 + 20).alias("x2"), (k * 11 % 100).alias("y1"), (k * 11 % 100 + 20).alias("y2")))


@query("bubble_crowding", "WITH p AS (SELECT p_size AS page, p_partkey AS id, CAST(p_partkey * 37 % 200 AS DOUBLE) AS x, CAST(p_partkey * 53 % 280 AS DOUBLE) AS y FROM part) SELECT a.page, a.id AS a, b.id AS b, CASE WHEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 64 THEN 'overlap' ELSE 'crowded' END AS kind FROM p a JOIN p b ON a.page = b.page AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 144")
def _(spark, d):
    k = F.col("p_partkey")
    pts = A.table(spark, d, "part").select(F.col("p_size").alias("page"), k.alias("id"), (k * 37 % 200).cast("double").alias("x"), (k * 53 % 280).cast("double").alias("y"))
    return K.crowded(pts, 4.0, 4.0)


# constraints


@query("key_violations", A.sql("responses answer_key", "SELECT q_no AS key, rule FROM (SELECT q.q_no, unnest(list_filter([CASE WHEN k.answer IS NULL THEN 'covered' END, CASE WHEN NOT coalesce(k.marks >= 0, FALSE) THEN 'marks' END, CASE WHEN NOT coalesce(k.answer IN ('A', 'B', 'C', 'D') OR regexp_matches(k.answer, '^[0-9|,]+$'), FALSE) THEN 'option' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT DISTINCT q_no FROM responses) q LEFT JOIN answer_key k USING (q_no))"))
def _(spark, d):
    j = A.responses(spark, d).select("q_no").distinct().join(A.answer_key(spark), "q_no", "left")
    return K.violations(j, "q_no", {"covered": F.col("answer").isNotNull(), "marks": F.col("marks") >= 0, "option": F.col("answer").isin("A", "B", "C", "D") | F.col("answer").rlike("^[0-9|,]+$")})


@query("roster_violations", A.sql("roster", "SELECT roll_no AS key, 'duplicate' AS rule FROM (SELECT CASE WHEN student_key % 100 = 1 THEN '2000001' ELSE roll_no END AS roll_no FROM roster) GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    r = A.roster(spark, d).withColumn("roll_no", F.when(F.col("student_key") % 100 == 1, "2000001").otherwise(F.col("roll_no")))
    return K.violations(r.groupBy("roll_no").count(), "roll_no", {"duplicate": F.col("count") == 1})


@query("marks_violations", "SELECT c_custkey AS key, unnest(list_filter([CASE WHEN NOT c_acctbal >= 0 THEN 'negative' END, CASE WHEN NOT c_acctbal <= 9000 THEN 'above_total' END, CASE WHEN c_nationkey >= 20 THEN 'unknown_roll' END], lambda x: x IS NOT NULL)) AS rule FROM customer")
def _(spark, d):
    c = A.table(spark, d, "customer")
    return K.violations(c, "c_custkey", {"negative": F.col("c_acctbal") >= 0, "above_total": F.col("c_acctbal") <= 9000, "unknown_roll": F.col("c_nationkey") < 20})


@query("queue_violations", A.sql("roster", "SELECT student_key AS key, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_email' END, CASE WHEN student_key % 12 = 0 THEN 'not_eligible' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM (SELECT *, CASE WHEN student_key % 40 < 2 THEN 'same' || student_key // 40 ELSE email END AS e FROM roster))"))
def _(spark, d):
    from pyspark.sql import Window

    k = F.col("student_key")
    r = A.roster(spark, d).withColumn("e", F.when(k % 40 < 2, F.concat(F.lit("same"), F.floor(k / 40).cast("string"))).otherwise(F.col("email")))
    r = r.withColumn("n", F.count("*").over(Window.partitionBy("e")))
    return K.violations(r, "student_key", {"duplicate_email": F.col("n") == 1, "not_eligible": k % 12 != 0})


@query("assignment_violations", f"WITH r AS ({RANGES}) SELECT marker AS key, unnest(list_filter([CASE WHEN NOT first > 0 THEN 'first' END, CASE WHEN NOT last > first THEN 'order' END], lambda x: x IS NOT NULL)) AS rule FROM r")
def _(spark, d):
    return K.violations(ranges(spark, d), "marker", {"first": F.col("first") > 0, "order": F.col("last") > F.col("first")})


@query("final_component_override", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 50.0::DOUBLE END, CAST(c_custkey % 40 AS DOUBLE)) AS score FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    final, total = F.when(k % 3 == 0, 50.0), F.when(k % 2 == 0, 60.0)
    return A.table(spark, d, "customer").select("c_custkey", F.coalesce(F.when(total.isNotNull(), final), (k % 40).cast("double")).alias("score"))


@query("results_csv_rows", A.sql("responses answer_key", GRADED + "SELECT sheet, CAST(CAST(score AS BIGINT) AS VARCHAR) AS score, CASE WHEN review_flags > 0 THEN 'review ' || review_flags ELSE '' END AS flags FROM scores"))
def _(spark, d):
    t = G.totals(graded(spark, d), ["sheet"])
    flags = F.when(F.col("review_flags") > 0, F.array(F.concat(F.lit("review\n"), F.col("review_flags").cast("string")))).otherwise(F.array().cast("array<string>"))
    return t.select("sheet", P.number_text(F.col("score")).alias("score"), P.join_flags(flags).alias("flags"))
