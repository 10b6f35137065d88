"""Queries on normalisation, reading and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import scalars as P
from gradeloom.operators import grading as G
from gradeloom.operators import reading as B
from gradeloom.plans import adapters as A

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


GRADED = """, graded AS (SELECT r.*, k.answer, CASE WHEN k.marks IS NULL OR k.marks = 0 THEN 0.0::DOUBLE ELSE k.marks END AS marks,
 CASE WHEN k.marks IS NOT NULL AND k.marks <> 0 AND r.outcome = 'answered' AND r.selected = k.answer THEN k.marks ELSE 0.0::DOUBLE END AS awarded,
 coalesce(k.marks = 0, FALSE) AS dropped, k.marks IS NULL AS no_key, (NOT coalesce(k.marks = 0, FALSE)) AND (r.confidence <> 'high' OR k.marks IS NULL) AS review
 FROM responses r LEFT JOIN answer_key k USING (q_no)),
scores AS (SELECT sheet, sum(awarded) AS score, sum(marks) AS total, count(*) FILTER (review) AS review_flags, count(*) FILTER (dropped) AS dropped FROM graded GROUP BY sheet)
"""


def graded(spark, d):
    return G.grade_mcq(A.responses(spark, d), A.answer_key(spark))


@query("objective_scores", A.sql("responses answer_key", GRADED + "SELECT *, CASE WHEN review_flags > 0 THEN 'needs_review' ELSE 'ready' END AS status FROM scores"))
def _(spark, d):
    return G.totals(graded(spark, d), ["sheet"])


@query("dropped_question_totals", A.sql("responses answer_key", GRADED + "SELECT q_no, count(*) AS n, count(*) FILTER (dropped) AS dropped, sum(awarded) AS awarded, sum(marks) AS marks, count(*) FILTER (no_key) AS no_key FROM graded GROUP BY q_no"))
def _(spark, d):
    return graded(spark, d).groupBy("q_no").agg(F.count("*").alias("n"), F.count_if("dropped").alias("dropped"), F.sum("awarded").alias("awarded"), F.sum("marks").alias("marks"), F.count_if("no_key").alias("no_key"))


@query("score_status_counts", A.sql("responses answer_key", GRADED + "SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('ready'), ('needs_review'), ('rejected')) s(status) LEFT JOIN (SELECT CASE WHEN review_flags > 0 THEN 'needs_review' ELSE 'ready' END AS status, count(*) AS n FROM scores GROUP BY 1) USING (status)"))
def _(spark, d):
    known = spark.createDataFrame([("ready",), ("needs_review",), ("rejected",)], "status string")
    counts = G.totals(graded(spark, d), ["sheet"]).groupBy("status").agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("legacy_evaluate", A.sql("responses answer_key", "SELECT sheet, sum(coalesce(k.marks, 0)) AS total, sum(CASE WHEN outcome = 'answered' AND selected = answer THEN k.marks ELSE 0 END) AS score, CASE WHEN bool_or(confidence <> 'high' OR k.marks IS NULL) THEN 'needs_review' ELSE 'ready' END AS status FROM responses LEFT JOIN answer_key k USING (q_no) GROUP BY sheet"))
def _(spark, d):
    return G.legacy_grade(A.responses(spark, d), A.answer_key(spark)).groupBy("sheet").agg(F.sum("marks").alias("total"), F.sum("awarded").alias("score"), F.when(F.bool_or("review"), "needs_review").otherwise("ready").alias("status"))


@query("roster_normalized", A.sql("roster", """SELECT student_key, CASE WHEN program IN ('MTECH', 'PHD') THEN program ELSE 'BTECH' END AS program, roll_no AS roll, name,
 CASE program WHEN 'BTECH' THEN regexp_matches(roll_no, '^\\d{7}$') WHEN 'MTECH' THEN regexp_matches(roll_no, '^MT\\d{5}$') ELSE regexp_matches(roll_no, '^PHD\\d{5}$') END AS valid FROM roster"""))
def _(spark, d):
    raw = A.roster(spark, d).withColumn("raw_roll", F.concat(F.lit(" "), F.lower(F.regexp_replace("roll_no", "^(MT|PHD)", "")), F.lit("\t")))
    program = P.infer_program(F.lit(""), F.col("roll_no"), F.lit(""))
    roll = P.normalize_roll(F.col("raw_roll"), program)
    return raw.select("student_key", program.alias("program"), roll.alias("roll"), "name", P.valid_roll(roll, program).alias("valid"))


@query("program_inference", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'PHD' WHEN p_partkey % 4 = 1 THEN 'MTECH' WHEN p_partkey % 4 = 2 THEN 'BTECH' WHEN p_partkey % 8 = 3 THEN 'MTECH' ELSE '' END AS program FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, "Ph.D").otherwise("")
    roll = F.when(k % 4 == 1, " mt24001 ").when(k % 4 == 2, "2024001").otherwise("x")
    context = F.when(k % 8 == 3, "exam mtech 2024").otherwise("exam")
    return A.table(spark, d, "part").select("p_partkey", P.infer_program(value, roll, context).alias("program"))


@query("email_validity", A.sql("roster", "SELECT student_key, CASE WHEN student_key % 10 = 3 THEN NULL ELSE email END AS email FROM roster"))
def _(spark, d):
    other = F.when(F.col("student_key") % 10 == 3, F.lit("second@example.edu")).otherwise(F.lit("no address"))
    return A.roster(spark, d).select("student_key", P.email_of([F.col("name"), F.concat(F.lit(" "), F.col("email")), other]).alias("email"))


@query("ocr_confusion_map", A.sql("roster", "SELECT student_key, roll_no AS roll FROM roster"))
def _(spark, d):
    digits = F.translate(F.regexp_replace("roll_no", "^(MT|PHD)", ""), "0158", "OISB")
    text = F.concat(F.lit("-"), F.regexp_extract("roll_no", "^(MT|PHD)", 1), F.lit(" "), digits, F.lit("."))
    return A.roster(spark, d).select("student_key", P.ocr_roll(text, F.col("program")).alias("roll"))


@query("roll_format_check", A.sql("roster", "SELECT program, count(*) AS n, count(*) FILTER (CASE program WHEN 'BTECH' THEN regexp_matches(r, '^\\d{7}$') WHEN 'MTECH' THEN regexp_matches(r, '^MT\\d{5}$') ELSE regexp_matches(r, '^PHD\\d{5}$') END) AS valid FROM (SELECT program, CASE WHEN student_key % 6 = 0 THEN roll_no || '0' ELSE roll_no END AS r FROM roster) GROUP BY program"))
def _(spark, d):
    r = F.when(F.col("student_key") % 6 == 0, F.concat("roll_no", F.lit("0"))).otherwise(F.col("roll_no"))
    return A.roster(spark, d).groupBy("program").agg(F.count("*").alias("n"), F.count_if(P.valid_roll(r, F.col("program"))).alias("valid"))


@query("roll_digits", A.sql("roster", "SELECT roll_no, CAST(pos AS INTEGER) AS pos, substr(d, CAST(pos AS INTEGER), 1) AS digit FROM (SELECT roll_no, regexp_replace(roll_no, '^(PHD|MT)', '') AS d FROM roster), range(1, 8) t(pos) WHERE pos <= length(d)"))
def _(spark, d):
    r = A.roster(spark, d)
    return r.select("roll_no", F.posexplode(P.roll_labels(F.col("roll_no"), F.col("program"))).alias("pos", "digit")).select("roll_no", (F.col("pos") + 1).alias("pos"), "digit")


@query("selector_state", A.sql("responses answer_key bubbles", "SELECT sheet, q_no, CASE WHEN count(*) FILTER (fill >= 0.5) = 1 THEN 'clear' WHEN count(*) FILTER (fill >= 0.5) > 1 THEN 'ambiguous' WHEN bool_or(fill >= 0.28 OR ink >= 0.24) THEN 'ambiguous' ELSE 'blank' END AS state FROM bubbles GROUP BY sheet, q_no"))
def _(spark, d):
    g = A.bubbles(spark, d).groupBy("sheet", "q_no").agg(F.collect_list("fill").alias("fills"), F.collect_list("ink").alias("inks"))
    return g.select("sheet", "q_no", P.selector_state(F.col("fills"), F.col("inks")).alias("state"))


@query("number_parse", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS value, CASE WHEN c_acctbal = floor(c_acctbal) THEN 'whole' ELSE 'part' END AS kind FROM customer")
def _(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    whole = ~P.number_text(F.col("c_acctbal")).contains(".")
    return A.table(spark, d, "customer").select("c_custkey", P.number_or(text).alias("value"), F.when(whole, "whole").otherwise("part").alias("kind"))


@query("bool_parse", "SELECT event_type, CASE WHEN event_type = 'click' THEN TRUE WHEN event_type IN ('view', 'error') THEN FALSE END AS flag, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    text = F.when(F.col("event_type") == "click", " Yes ").when(F.col("event_type") == "view", "0").when(F.col("event_type") == "error", "").otherwise("perhaps")
    return A.table(spark, d, "events").groupBy("event_type", P.parse_bool(text).alias("flag")).agg(F.count("*").alias("n"))


@query("flag_join", "SELECT conv_id, string_agg(role || ' ' || turn, ' | ' ORDER BY turn, role, text) AS flags FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = A.table(spark, d, "conversations")
    flags = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws("\n", x["role"], x["turn"].cast("string")))
    return c.groupBy("conv_id").agg(flags.alias("f")).select("conv_id", P.join_flags(F.col("f")).alias("flags"))


@query("safe_ids", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS id FROM pages")
def _(spark, d):
    return A.table(spark, d, "pages").select("page_id", P.safe_id(F.col("url")).alias("id"))


@query("header_keys", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS key FROM pages")
def _(spark, d):
    return A.table(spark, d, "pages").select("page_id", P.header_key(F.col("url")).alias("key"))


@query("text_quality", """SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.20::DOUBLE + 0.48::DOUBLE * (a / greatest(n, 1)) + 0.22::DOUBLE * least(1.0::DOUBLE, n / 14.0::DOUBLE) - 0.35::DOUBLE * ((n - a) / greatest(n, 1)) - least(0.30::DOUBLE, 0.12::DOUBLE * r))) END AS quality
 FROM (SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS a, len(regexp_extract_all(text, '[_=\\-]{3,}|[^0-9A-Za-z_\\s]{4,}')) AS r FROM documents)""")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", P.text_quality(F.col("text")).alias("quality"))


@query("noise_lines", """SELECT conv_id, turn, count(*) FILTER (noisy) AS noisy, count(*) AS n FROM (SELECT conv_id, turn,
 (n >= 18 AND (n - a) / greatest(n, 1) >= 0.55) OR (n >= 24 AND top / greatest(a, 1) >= 0.70) OR (a >= 5 AND top / greatest(a, 1) >= 0.85 AND (n - a) / greatest(n, 1) >= 0.25) AS noisy
 FROM (SELECT conv_id, turn, length(regexp_replace(text, '\\s+', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS a,
 list_max(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda c: length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) - length(replace(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), c, '')))) AS top FROM conversations)) GROUP BY conv_id, turn""")
def _(spark, d):
    c = A.table(spark, d, "conversations")
    return c.groupBy("conv_id", "turn").agg(F.count_if(P.noise_line(F.col("text"))).alias("noisy"), F.count("*").alias("n"))


MEDIANS = """, base AS (SELECT sheet, q_no, median(ink) FILTER (fill < 0.28) AS low, median(ink) AS all_ink FROM bubbles GROUP BY sheet, q_no),
ranked AS (SELECT b.*, coalesce(low, all_ink) AS baseline, row_number() OVER (PARTITION BY b.sheet, b.q_no ORDER BY fill DESC, option) AS place FROM bubbles b JOIN base USING (sheet, q_no)),
assessed AS (SELECT sheet, q_no, count(*) FILTER (fill >= 0.5) AS filled, max(option) FILTER (place = 1) AS top, max(fill) FILTER (place = 1) - coalesce(max(fill) FILTER (place = 2), 0) AS margin,
 bool_or(place > 1 AND (fill >= 0.28 OR (ink >= 0.24 AND ink - baseline >= 0.10))) AS others, bool_or(fill >= 0.28 OR (ink >= 0.24 AND ink - baseline >= 0.10)) AS marked, max(fill) AS most FROM ranked GROUP BY sheet, q_no),
mcq AS (SELECT sheet, q_no, CASE WHEN filled > 1 THEN 'multiple' WHEN filled = 1 THEN 'answered' ELSE 'blank' END AS outcome, CASE WHEN filled = 1 THEN top END AS selected,
 CASE WHEN filled > 1 THEN 'low' WHEN filled = 1 AND margin < 0.18 THEN 'low' WHEN filled = 1 AND others THEN 'medium' WHEN filled = 1 THEN 'high' WHEN marked THEN 'low' ELSE 'high' END AS confidence, most FROM assessed)
"""
FAINT = """, eranked AS (SELECT *, row_number() OVER (PARTITION BY sheet, q_no ORDER BY enhanced DESC, option) AS place FROM bubbles),
faint AS (SELECT sheet, q_no, max(option) FILTER (place = 1) AS best, max(enhanced) FILTER (place = 1) AS v, max(enhanced) FILTER (place = 1) - coalesce(max(enhanced) FILTER (place = 2), 0) AS margin,
 max(ink) FILTER (place = 1) - coalesce(median(ink) FILTER (place > 1), 0) AS excess FROM eranked GROUP BY sheet, q_no),
prov AS (SELECT sheet, q_no, CASE WHEN v >= 0.5 AND margin >= 0.18 AND excess >= 0.055 THEN best END AS provisional FROM faint)
"""


@query("mcq_assess", A.sql("bubbles", MEDIANS + "SELECT sheet, q_no, outcome, selected, confidence, confidence <> 'high' AS needs_review FROM mcq"))
def _(spark, d):
    return B.assess_mcq(A.bubbles(spark, d)).drop("margin")


@query("faint_provisional", A.sql("bubbles", FAINT + "SELECT sheet, q_no, provisional FROM prov"))
def _(spark, d):
    return B.faint_option(A.bubbles(spark, d))


@query("mcq_read", A.sql("bubbles", MEDIANS + FAINT + """SELECT sheet, q_no, CASE WHEN up THEN 'answered' ELSE outcome END AS outcome, CASE WHEN up THEN provisional ELSE selected END AS selected, CASE WHEN up THEN 'low' ELSE confidence END AS confidence, up OR confidence <> 'high' AS needs_review
 FROM (SELECT m.*, p.provisional, m.outcome = 'blank' AND m.most < 0.5 AND p.provisional IS NOT NULL AS up FROM mcq m JOIN prov p USING (sheet, q_no))"""))
def _(spark, d):
    return B.read_mcq(A.bubbles(spark, d))


@query("top2_margin", A.sql("bubbles", "SELECT sheet, q_no, best, best_value, margin FROM (SELECT sheet, q_no, option AS best, fill AS best_value, fill - coalesce(lead(fill) OVER w, 0) AS margin, row_number() OVER w AS place FROM bubbles WINDOW w AS (PARTITION BY sheet, q_no ORDER BY fill DESC, option)) WHERE place = 1"))
def _(spark, d):
    return B.top_two(A.bubbles(spark, d), ["sheet", "q_no"])


@query("numerical_read", A.sql("responses", """, told AS (SELECT sheet, bool_or(outcome = 'multiple') AS many, bool_and(outcome = 'blank') AS none, bool_or(outcome = 'blank') AS any_blank, string_agg(CASE WHEN outcome = 'answered' THEN CAST(value % 10 AS VARCHAR) ELSE '?' END, '' ORDER BY q_no) AS digits_text, bool_or(confidence <> 'high') AS needs_review FROM responses GROUP BY sheet)
 SELECT sheet, CASE WHEN many THEN 'multiple' WHEN none THEN 'blank' WHEN any_blank THEN 'incomplete' ELSE 'answered' END AS outcome, digits_text, needs_review, CASE WHEN NOT many AND NOT none AND NOT any_blank THEN CAST(digits_text AS INTEGER) END AS value FROM told"""))
def _(spark, d):
    r = A.responses(spark, d)
    places = r.select("sheet", F.col("q_no").alias("place"), "outcome", F.when(F.col("outcome") == "answered", (F.col("value") % 10).cast("string")).alias("selected"), (F.col("confidence") != "high").alias("needs_review"))
    return B.read_numerical(places, ["sheet"])


@query("numerical_grade", A.sql("responses answer_key", """, alt AS (SELECT q_no, marks AS key_marks, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(answer, '[|,]'), lambda x: regexp_matches(x, '^\\d+$')), lambda x: CAST(x AS INTEGER)))) AS vals FROM answer_key)
 SELECT sheet, q_no, value, CASE WHEN key_marks = 0 THEN 0.0::DOUBLE ELSE key_marks END AS marks, CASE WHEN key_marks IS NULL THEN NULL WHEN key_marks > 0 AND list_contains(vals, value) THEN key_marks ELSE 0.0::DOUBLE END AS awarded, coalesce(key_marks = 0, FALSE) AS dropped FROM responses LEFT JOIN alt USING (q_no)"""))
def _(spark, d):
    return G.grade_numerical(A.responses(spark, d).select("sheet", "q_no", "value"), A.answer_key(spark))


@query("strict_and_lenient_totals", A.sql("responses answer_key", """, g AS (SELECT sheet, CASE WHEN k.marks IS NULL THEN NULL WHEN k.marks > 0 AND r.value IN (12, 34, 56) AND q_no = 6 THEN k.marks ELSE 0.0::DOUBLE END AS awarded, CASE WHEN k.marks = 0 THEN 0.0::DOUBLE ELSE k.marks END AS marks FROM responses r LEFT JOIN answer_key k USING (q_no))
 SELECT sheet, CASE WHEN bool_and(awarded IS NOT NULL) THEN sum(awarded) END AS strict, sum(awarded) AS lenient FROM g GROUP BY sheet"""))
def _(spark, d):
    g = G.grade_numerical(A.responses(spark, d).select("sheet", "q_no", "value"), A.answer_key(spark))
    return G.strict_total(g, ["sheet"]).select("sheet", F.col("score").alias("strict")).join(G.lenient_total(g, ["sheet"]).select("sheet", F.col("score").alias("lenient")), "sheet")


@query("numerical_key_alternatives", "SELECT p_partkey AS q_no, len(v) AS n, v[1] AS first FROM (SELECT p_partkey, list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(answer, '[|,]'), lambda x: replace(x, ' ', '')), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS INTEGER)))) AS v FROM (SELECT p_partkey, p_size || ' | ' || p_partkey % 50 || ',' || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '007' END AS answer FROM part))")
def _(spark, d):
    """A key of alternatives for each part."""
    k = F.col("p_partkey")
    answer = F.concat(F.col("p_size").cast("string"), F.lit(" | "), (k % 50).cast("string"), F.lit(","), F.when(k % 3 == 0, "x").otherwise("007"))
    v = G.key_values(answer)
    return A.table(spark, d, "part").select(k.alias("q_no"), F.size(v).cast("long").alias("n"), F.get(v, F.lit(0)).alias("first"))


@query("roll_grid_decode", A.sql("responses", ", g AS (SELECT sheet, string_agg(CASE WHEN outcome = 'answered' OR (outcome = 'blank' AND value % 2 = 0) THEN CAST(value % 10 AS VARCHAR) ELSE '?' END, '' ORDER BY q_no) AS read, bool_or(outcome = 'blank') AS flagged FROM responses GROUP BY sheet) SELECT sheet, read, flagged, CASE WHEN position('?' IN read) = 0 THEN read END AS roll FROM g"))
def _(spark, d):
    r = A.responses(spark, d)
    cols = r.select("sheet", F.col("q_no").alias("place"), F.when(F.col("outcome") == "answered", 1).when(F.col("outcome") == "multiple", 2).otherwise(0).alias("filled"), (1 - F.col("value") % 2).alias("faint"), (F.col("value") % 10).cast("string").alias("digit"))
    return B.decode_grid(cols, ["sheet"])


@query("program_reconcile", A.sql("pages", "SELECT source_index, CASE WHEN selector_state = 'clear' THEN cell_program WHEN source_index % 3 = 0 AND source_index % 2 = 0 THEN cell_program END AS program FROM pages"))
def _(spark, d):
    p = A.pages(spark, d)
    selector = F.when(F.col("selector_state") == "clear", F.col("cell_program"))
    completed = F.when(F.col("source_index") % 3 == 0, F.array("cell_program")).otherwise(F.array("cell_program", F.lit("OTHER")))
    return p.select("source_index", B.reconcile_program(selector, completed, F.col("source_index") % 2 == 1).alias("program"))


CELLS = ", cells AS (SELECT sheet, q_no AS place, CASE WHEN outcome = 'blank' THEN '' ELSE CAST(value % 10 AS VARCHAR) END AS digit, (value + 1) / 101.0::DOUBLE AS p FROM responses)"


def cells(spark, d):
    return A.responses(spark, d).select("sheet", F.col("q_no").alias("place"), F.when(F.col("outcome") == "blank", "").otherwise((F.col("value") % 10).cast("string")).alias("digit"), ((F.col("value") + 1) / 101.0).alias("p"))


@query("cell_min_confidence", A.sql("responses", CELLS + "SELECT sheet, string_agg(CASE WHEN digit = '' THEN '?' ELSE digit END, '' ORDER BY place) AS read, min(CASE WHEN digit = '' THEN 0.0::DOUBLE ELSE p END) AS confidence, count(*) FILTER (digit = '') AS blanks, count(*) FILTER (digit = '') >= 2 AS empty_field FROM cells GROUP BY sheet"))
def _(spark, d):
    return B.cells_read(cells(spark, d), ["sheet"]).drop("mean_p")


@query("geometric_mean_min", A.sql("responses", CELLS + "SELECT sheet, floor(exp(avg(ln(greatest(p, 1e-6)))) * 1e6 + 0.5) / 1e6 AS mean_p, min(p) AS min_p FROM cells GROUP BY sheet"))
def _(spark, d):
    c = cells(spark, d)
    return c.groupBy("sheet").agg((F.floor(F.exp(F.avg(F.ln(F.greatest("p", F.lit(1e-6))))) * 1e6 + 0.5) / 1e6).alias("mean_p"), F.min("p").alias("min_p"))


@query("median_percentile", A.sql("bubbles", "SELECT q_no, median(ink) AS middle, quantile_cont(fill, 0.8) AS p80, quantile_cont(fill, 0.55) AS p55 FROM bubbles GROUP BY q_no"))
def _(spark, d):
    return A.bubbles(spark, d).groupBy("q_no").agg(F.median("ink").alias("middle"), F.percentile("fill", F.lit(0.8)).alias("p80"), F.percentile("fill", F.lit(0.55)).alias("p55"))


@query("write_in_reconcile", A.sql("pages", """, reads AS (SELECT student_key, coalesce(bubble_roll, '') AS roll, CASE WHEN source_index % 6 = 0 THEN NULL ELSE cell_min END AS confidence FROM pages),
 r AS (SELECT *, row_number() OVER (PARTITION BY student_key ORDER BY coalesce(confidence, 0.65) DESC, roll) AS place FROM reads)
 SELECT student_key, max(roll) FILTER (place = 1) AS roll, count(DISTINCT roll) > 1 AS conflict, max(CASE WHEN coalesce(confidence, 0.65) >= 0.82 THEN 'high' WHEN coalesce(confidence, 0.65) >= 0.60 THEN 'medium' ELSE 'low' END) FILTER (place = 1) AS band FROM r GROUP BY student_key"""))
def _(spark, d):
    reads = A.pages(spark, d).select("student_key", F.coalesce("bubble_roll", F.lit("")).alias("roll"), F.when(F.col("source_index") % 6 == 0, F.lit(None).cast("double")).otherwise(F.col("cell_min")).alias("confidence"))
    return B.reconcile_reads(reads, ["student_key"])


@query("digit_vote", A.sql("predictions", """, v AS (SELECT crop % 200 AS cell, predicted AS digit, count(*) AS votes, median(confidence) AS middle, max(confidence) AS most FROM predictions GROUP BY 1, 2),
 r AS (SELECT *, sum(votes) OVER (PARTITION BY cell) AS all_votes, row_number() OVER (PARTITION BY cell ORDER BY votes DESC, middle DESC, most DESC, digit) AS place FROM v)
 SELECT cell, digit, votes, least(0.99::DOUBLE, 0.30::DOUBLE * votes / all_votes + 0.70::DOUBLE * middle) AS confidence FROM r WHERE place = 1"""))
def _(spark, d):
    reads = A.predictions(spark, d).select((F.col("crop") % 200).alias("cell"), F.col("predicted").alias("digit"), "confidence")
    return B.vote_digits(reads, ["cell"])


@query("quality_score_gate", """SELECT o_orderkey AS page, greatest(0.0::DOUBLE, 1.0::DOUBLE - least(0.60::DOUBLE, (o_orderkey % 5) * 0.18::DOUBLE) - least(0.20::DOUBLE, (o_orderkey % 6) * 0.05::DOUBLE)) AS score,
 CAST((o_orderkey % 100 < 58) AS INTEGER) + CAST((o_orderkey % 110 > 90) AS INTEGER) + CAST((o_orderkey % 99 < 45) AS INTEGER) + CAST((o_orderkey % 98 < 18) AS INTEGER) + CAST((o_orderkey % 97 < 72) AS INTEGER) + CAST((o_orderkey % 20 < 5) AS INTEGER) + CAST((o_orderkey % 255 < 135) AS INTEGER) AS failed FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    m = {"dark": (k % 100) / 100, "residual": (k % 110) / 100, "bar": (k % 99) / 100, "contrast": (k % 98) / 100, "anchors": (k % 97) / 100, "blur": k % 20, "median": k % 255}
    return A.table(spark, d, "orders").select(k.alias("page"), B.alignment_score(k % 5, k % 6).alias("score"), B.alignment_gates(m).alias("failed"))


@query("page_index_detect", A.sql("bubbles", "SELECT sheet, CASE WHEN count(*) FILTER (fill >= 0.45) = 1 THEN max(q_no) FILTER (fill >= 0.45) END AS page, max(fill) AS confidence FROM bubbles WHERE option = 'A' GROUP BY sheet"))
def _(spark, d):
    bars = A.bubbles(spark, d).where("option = 'A'").select("sheet", F.col("q_no").alias("page"), F.col("fill").alias("bar"))
    return B.detect_page(bars, ["sheet"])


@query("answer_confidence_band", "SELECT conv_id, CASE WHEN c >= 0.82 AND NOT flagged THEN 'high' WHEN c >= 0.60 THEN 'medium' ELSE 'low' END AS band FROM (SELECT conv_id, median((length(text) % 50 + 50) / 100.0::DOUBLE) FILTER (text <> '') AS c, bool_or(turn > 3) AS flagged FROM conversations GROUP BY conv_id)")
def _(spark, d):
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.median(F.when(F.col("text") != "", (F.length("text") % 50 + 50) / 100.0)).alias("c"), F.bool_or(F.col("turn") > 3).alias("flagged"))
    told = B.band(F.col("c"))
    return c.select("conv_id", F.when((told == "high") & F.col("flagged"), "medium").otherwise(told).alias("band"))


@query("identity_dispatch", A.sql("pages", "SELECT source_index, CASE WHEN sheet_page = 1 AND bubble_roll IS NOT NULL THEN 'bubbled' WHEN sheet_page = 1 THEN 'write_in' ELSE 'handwritten' END AS kind, CASE WHEN sheet_page = 1 AND bubble_roll IS NOT NULL THEN bubble_roll ELSE cell_roll END AS roll FROM pages"))
def _(spark, d):
    kind, roll = B.dispatch_identity(F.col("sheet_page"), 1, F.col("bubble_roll"), F.col("cell_roll"))
    return A.pages(spark, d).select("source_index", kind.alias("kind"), roll.alias("roll"))


@query("candidate_ids", "SELECT o_orderkey, substr(sha256('v1|B|' || o_custkey || '|' || o_orderkey), 1, 20) AS id FROM orders")
def _(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", P.candidate_id(F.lit("v1"), F.lit("B"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("id"))


@query("clamp_and_ratio", "SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS clamped, CASE WHEN c_nationkey <> 0 THEN c_custkey / c_nationkey END AS ratio FROM customer")
def _(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", P.clamp(F.col("c_acctbal") / 5000).alias("clamped"), P.ratio(F.col("c_custkey"), F.col("c_nationkey")).alias("ratio"))


@query("millimetres_to_pixels", "SELECT p_partkey, CAST(round_even(p_size * 200 / 25.4, 0) AS BIGINT) AS px FROM part")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", P.to_px(F.col("p_size"), 200.0).alias("px"))
