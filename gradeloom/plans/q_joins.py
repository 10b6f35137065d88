"""Queries on lookups, reconciliation of several sources, regrading and text assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import grading as G
from gradeloom.operators import release as K
from gradeloom.operators import review as R
from gradeloom.plans import adapters as A
from gradeloom.plans.q_ownership import FOLD, SELECTED, selected

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("roster_lookup", A.sql("roster pages", "SELECT p.source_index, r.name, CASE WHEN r.roll_no IS NULL THEN 'not_in_roster' WHEN r.program <> p.cell_program THEN 'program_mismatch' ELSE '' END AS flag FROM pages p LEFT JOIN (SELECT * FROM roster WHERE student_key % 20 <> 0) r ON p.bubble_roll = r.roll_no"))
def _(spark, d):
    r = A.roster(spark, d).where("student_key % 20 <> 0").select("roll_no", "name", "program")
    j = A.pages(spark, d).join(r, F.col("bubble_roll") == F.col("roll_no"), "left")
    return j.select("source_index", "name", F.when(F.col("roll_no").isNull(), "not_in_roster").when(F.col("program") != F.col("cell_program"), "program_mismatch").otherwise("").alias("flag"))


@query("rubric_join", A.sql("responses", "SELECT r.sheet, r.q_no, p.p_name AS question_text, coalesce(p.p_size <> r.value, FALSE) AS max_mismatch FROM responses r LEFT JOIN part p ON p.p_partkey = r.q_no"))
def _(spark, d):
    rubric = A.table(spark, d, "part").select(F.col("p_partkey").alias("q_no"), F.col("p_name").alias("question_text"), "p_size")
    j = A.responses(spark, d).join(rubric, "q_no", "left")
    return j.select("sheet", "q_no", "question_text", F.coalesce(F.col("p_size") != F.col("value"), F.lit(False)).alias("max_mismatch"))


@query("release_reconcile", A.sql("roster", """, pdf AS (SELECT roll_no FROM roster WHERE student_key % 7 <> 0 UNION ALL SELECT 'X' || student_key FROM roster WHERE student_key % 50 = 1), mk AS (SELECT roll_no FROM roster WHERE student_key % 9 <> 0)
 SELECT roll_no, string_agg(problem, ',' ORDER BY problem) AS problems FROM (SELECT r.roll_no, 'missing_pdf' AS problem FROM roster r WHERE roll_no NOT IN (SELECT roll_no FROM pdf) UNION ALL SELECT roll_no, 'unknown_pdf' FROM pdf WHERE roll_no NOT IN (SELECT roll_no FROM roster) UNION ALL SELECT roll_no, 'missing_marks' FROM roster WHERE roll_no NOT IN (SELECT roll_no FROM mk)) GROUP BY roll_no"""))
def _(spark, d):
    r = A.roster(spark, d)
    k = F.col("student_key")
    pdf = r.where(k % 7 != 0).select("roll_no").unionByName(r.where(k % 50 == 1).select(F.concat(F.lit("X"), k.cast("string")).alias("roll_no")))
    a = R.reconcile(r, pdf, "roll_no").select("roll_no", F.when(F.col("status") == "missing", "missing_pdf").when(F.col("status") == "unexpected", "unknown_pdf").alias("problem"))
    b = R.reconcile(r, r.where(k % 9 != 0), "roll_no").select("roll_no", F.when(F.col("status") == "missing", "missing_marks").alias("problem"))
    return a.unionByName(b).where("problem IS NOT NULL").groupBy("roll_no").agg(F.array_join(F.array_sort(F.collect_list("problem")), ",").alias("problems"))


@query("eligible_release", A.sql("decisions pages", SELECTED + FOLD + "SELECT s.entity, s.status IN ('verified', 'approved') AND s.entity % 6 <> 0 AND coalesce(n = 3, FALSE) AND s.entity % 10 <> 3 AS eligible FROM state s LEFT JOIN (SELECT entity, count(DISTINCT slot) AS n FROM sel GROUP BY 1) USING (entity)"))
def _(spark, d):
    s = R.fold(A.decisions(spark, d))
    whole = R.missing_slots(selected(spark, d), 3).where(F.size("missing") == 0).select("entity", F.lit(True).alias("whole"))
    j = s.join(whole, "entity", "left")
    has_pdf, stale = F.col("entity") % 6 != 0, F.col("entity") % 10 == 3
    return j.select("entity", (F.col("status").isin("verified", "approved") & has_pdf & F.coalesce("whole", F.lit(False)) & ~stale).alias("eligible"))


@query("selection_changed", A.sql("decisions pages", SELECTED + ", a AS (SELECT entity, string_agg(slot || ':' || source, ',' ORDER BY slot, source) AS s FROM sel GROUP BY 1), b AS (SELECT student_key AS entity, string_agg(sheet_page || ':' || source_index, ',' ORDER BY sheet_page, source_index) AS s FROM pages GROUP BY 1) SELECT entity, a.s IS DISTINCT FROM b.s AS changed FROM a JOIN b USING (entity)"))
def _(spark, d):
    listed = lambda df: df.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("source").cast("long").alias("source")))).alias("s"))
    before = A.pages(spark, d).select(F.col("student_key").alias("entity"), F.col("sheet_page").alias("slot"), F.col("source_index").alias("source"))
    return listed(selected(spark, d)).join(listed(before).withColumnRenamed("s", "t"), "entity").select("entity", (F.col("s") != F.col("t")).alias("changed"))


@query("label_prediction_join", "WITH claims AS (SELECT o_orderkey AS candidate, unnest([o_orderkey + 1, o_orderkey + 2]) AS source, o_custkey AS roll FROM orders), lab AS (SELECT o_orderkey + 1 AS source, CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE o_custkey END AS truth FROM orders WHERE o_orderkey % 4 <> 1) SELECT c.candidate, count(*) AS pages, count(truth) AS labelled, count(*) FILTER (roll = truth) AS correct FROM claims c LEFT JOIN lab USING (source) GROUP BY 1")
def _(spark, d):
    o = A.table(spark, d, "orders")
    k = F.col("o_orderkey")
    claims = o.select(k.alias("candidate"), F.explode(F.array(k + 1, k + 2)).alias("source"), F.col("o_custkey").alias("roll"))
    labels = o.where(k % 4 != 1).select((k + 1).alias("source"), F.when(k % 6 == 0, -1).otherwise(F.col("o_custkey")).alias("truth"))
    j = claims.join(labels, "source", "left")
    return j.groupBy("candidate").agg(F.count("*").alias("pages"), F.count("truth").alias("labelled"), F.count_if(F.col("roll") == F.col("truth")).alias("correct"))


@query("answer_key_regrade", A.sql("responses answer_key", "SELECT sheet, sum(CASE WHEN q_no = 1 AND outcome = 'answered' AND selected = 'B' THEN 2 WHEN q_no <> 1 AND k.marks > 0 AND outcome = 'answered' AND selected = answer THEN k.marks ELSE 0 END)::DOUBLE AS regraded, sum(CASE WHEN k.marks > 0 AND outcome = 'answered' AND selected = answer THEN k.marks ELSE 0 END)::DOUBLE AS before FROM responses LEFT JOIN answer_key k USING (q_no) GROUP BY sheet"))
def _(spark, d):
    key = A.answer_key(spark)
    changed = key.withColumn("answer", F.when(F.col("q_no") == 1, "B").otherwise(F.col("answer")))
    r = A.responses(spark, d)
    total = lambda k, name: G.totals(G.grade_mcq(r, k), ["sheet"]).select("sheet", F.col("score").alias(name))
    return total(changed, "regraded").join(total(key, "before"), "sheet")


@query("text_ensemble", "WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(text) % 7 DESC, length(text) DESC, text, role) AS place FROM conversations) SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM c WHERE place = 1 GROUP BY conv_id")
def _(spark, d):
    c = A.table(spark, d, "conversations")
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc(F.length("text") % 7), F.desc(F.length("text")), "text", "role")
    best = c.withColumn("place", F.row_number().over(w)).where("place = 1")
    return best.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query("manifest_violations", "SELECT p_partkey AS key, unnest(list_filter([CASE WHEN p_size % 7 NOT IN (4, 5, 6) THEN 'version' END, CASE WHEN NOT p_size > 2 THEN 'pages' END, CASE WHEN p_retailprice < 950 THEN 'radius' END], lambda x: x IS NOT NULL)) AS rule FROM part")
def _(spark, d):
    return K.violations(A.table(spark, d, "part"), "p_partkey", {"version": (F.col("p_size") % 7).isin(4, 5, 6), "pages": F.col("p_size") > 2, "radius": F.col("p_retailprice") >= 950})
