"""Queries on page ownership, proposals, review state and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.evidence import blocked, codes, evidence, flag_when
from gradeloom.operators import ownership as O
from gradeloom.operators import review as R
from gradeloom.plans import adapters as A

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


VALID = "CASE {p} WHEN 'BTECH' THEN regexp_matches({r}, '^\\d{{7}}$') WHEN 'MTECH' THEN regexp_matches({r}, '^MT\\d{{5}}$') ELSE regexp_matches({r}, '^PHD\\d{{5}}$') END".format(p="cell_program", r="cell_roll")
CURRENT = "CASE WHEN source_index % 4 <> 0 THEN NULL WHEN source_index % 12 = 0 THEN '2000001' ELSE cell_roll END"
#: J2 as relations: rules as a list of codes, anchors, then continuations.
OWNED = f""", kn AS (SELECT DISTINCT roll_no FROM roster WHERE student_key % 50 <> 0),
p1 AS (SELECT p.*, CASE WHEN {VALID} THEN cell_roll END AS roll FROM pages p),
p2 AS (SELECT p1.*, k.roll_no AS known, count(roll) OVER (PARTITION BY roll, sheet_page) AS slot_claims, count(CASE WHEN sheet_page = 1 AND bubble_roll IS NOT NULL THEN 1 END) OVER (PARTITION BY bubble_roll) AS bubble_claims FROM p1 LEFT JOIN kn k ON p1.roll = k.roll_no),
p3 AS (SELECT *, list_filter([
 CASE WHEN quality <> 'ready' THEN 'QUALITY_UNAVAILABLE:block' END, CASE WHEN source_index <= 0 OR sheet_page NOT BETWEEN 1 AND 3 THEN 'INVALID_SOURCE_OR_SLOT:block' END,
 CASE WHEN roll IS NULL THEN 'CELL_ROLL_UNREADABLE:block' END, CASE WHEN roll IS NOT NULL AND NOT (cell_min BETWEEN 0.8 AND 1.0) THEN 'LOW_CELL_CONFIDENCE:block' END,
 CASE WHEN roll IS NOT NULL AND known IS NULL THEN 'ROLL_NOT_IN_ROSTER:block' END,
 CASE WHEN selector_state = 'blank' AND cell_program = 'BTECH' THEN 'PROGRAM_SELECTOR_BLANK:warn' WHEN selector_state = 'blank' THEN 'PROGRAM_SELECTOR_BLANK:block' WHEN selector_state <> 'clear' THEN 'PROGRAM_SELECTOR_AMBIGUOUS:block' END,
 CASE WHEN roll IS NOT NULL AND slot_claims <> 1 THEN 'DUPLICATE_AGREED_CLAIM:block' END,
 CASE WHEN sheet_page = 1 AND NOT coalesce(bubble_roll = roll, FALSE) THEN 'SOURCES_CONTRADICT:block' END, CASE WHEN sheet_page = 1 AND bubble_confidence NOT IN ('high', 'medium') THEN 'BUBBLE_IDENTITY_UNCERTAIN:block' END,
 CASE WHEN sheet_page = 1 AND bubble_roll IS NOT NULL AND bubble_claims <> 1 THEN 'DUPLICATE_AGREED_CLAIM:block' END], lambda x: x IS NOT NULL) AS own FROM p2),
anchors AS (SELECT roll AS anchor FROM p3 WHERE sheet_page = 1 AND roll IS NOT NULL AND len(list_filter(own, lambda x: x LIKE '%:block')) = 0),
p4 AS (SELECT p3.*, CASE WHEN sheet_page > 1 AND anchor IS NULL THEN list_append(own, 'NO_ANCHOR_FOR_ROLL:block') ELSE own END AS flags FROM p3 LEFT JOIN anchors ON roll = anchor),
owned AS (SELECT *, roll IS NOT NULL AND len(list_filter(flags, lambda x: x LIKE '%:block')) = 0 AS accepted FROM p4)
"""


def owned(spark, d):
    return O.assess_ownership(A.pages(spark, d), A.roster(spark, d).where("student_key % 50 <> 0"), 3)


def current(spark, d):
    """Pages with the roll they are attached to now, if any."""
    k = F.col("source_index")
    return A.pages(spark, d).withColumn("current_roll", F.when(k % 4 != 0, F.lit(None).cast("string")).when(k % 12 == 0, "2000001").otherwise(F.col("cell_roll")))


@query("page_ownership", A.sql("roster pages", OWNED + "SELECT source_index, sheet_page, roll, accepted, CASE WHEN accepted THEN 'auto_matched' WHEN roll IS NOT NULL OR bubble_roll IS NOT NULL THEN 'suggested' ELSE 'unmatched' END AS status, array_to_string(flags, ',') AS codes FROM owned"))
def _(spark, d):
    return O.told(owned(spark, d))


@query("claim_counts", A.sql("pages", f", p AS (SELECT *, CASE WHEN {VALID} THEN cell_roll END AS roll FROM pages) SELECT source_index, CASE WHEN sheet_page = 1 THEN count(CASE WHEN sheet_page = 1 AND bubble_roll IS NOT NULL THEN 1 END) OVER (PARTITION BY bubble_roll) ELSE 0 END AS bubble_claims, count(roll) OVER (PARTITION BY roll, sheet_page) AS slot_claims FROM p"))
def _(spark, d):
    p = A.pages(spark, d)
    return O.claim_counts(p.withColumn("roll", F.when(O.valid_roll(F.col("cell_roll"), F.col("cell_program")), F.col("cell_roll")))).select("source_index", "bubble_claims", "slot_claims")


@query("anchor_accept", A.sql("roster pages", OWNED + "SELECT roll, source_index FROM owned WHERE accepted AND sheet_page = 1"))
def _(spark, d):
    return owned(spark, d).where("accepted AND sheet_page = 1").select("roll", "source_index")


@query("continuation_attach", A.sql("roster pages", OWNED + "SELECT sheet_page, count(*) AS pages, count(*) FILTER (accepted) AS attached FROM owned WHERE sheet_page > 1 GROUP BY sheet_page"))
def _(spark, d):
    return owned(spark, d).where("sheet_page > 1").groupBy("sheet_page").agg(F.count("*").alias("pages"), F.count_if("accepted").alias("attached"))


@query("student_completeness", A.sql("roster pages", OWNED + """, held AS (SELECT roll, list(sheet_page ORDER BY sheet_page, source_index) AS slots, string_agg(CAST(source_index AS VARCHAR), ',' ORDER BY sheet_page, source_index) AS sources FROM owned WHERE accepted GROUP BY roll)
 SELECT roll, sources, array_to_string(list_filter([1, 2, 3], lambda x: NOT list_contains(slots, x)), ',') AS missing, CASE WHEN len(list_filter([1, 2, 3], lambda x: NOT list_contains(slots, x))) = 0 THEN 'auto_matched' ELSE 'missing_pages' END AS status FROM held"""))
def _(spark, d):
    c = O.completeness(owned(spark, d), 3)
    return c.select("roll", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "status")


@query("blocking_flags", A.sql("roster pages", OWNED + "SELECT split_part(f, ':', 1) AS code, split_part(f, ':', 2) AS severity, count(*) AS n FROM (SELECT unnest(flags) AS f FROM owned) GROUP BY 1, 2"))
def _(spark, d):
    return owned(spark, d).select(F.explode("flags").alias("f")).groupBy(F.col("f.code").alias("code"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("selector_quality_rules", A.sql("pages", "SELECT source_index, CASE WHEN selector_state = 'blank' AND cell_program = 'BTECH' THEN 'PROGRAM_SELECTOR_BLANK:warn' WHEN selector_state = 'blank' THEN 'PROGRAM_SELECTOR_BLANK:block' WHEN selector_state = 'clear' THEN CASE WHEN source_index % 9 = 0 THEN 'SOURCES_CONTRADICT:block' ELSE '' END ELSE 'PROGRAM_SELECTOR_AMBIGUOUS:block' END AS codes, quality = 'ready' AND NOT (selector_state = 'ambiguous') AS passes FROM pages"))
def _(spark, d):
    p = A.pages(spark, d)
    flags = O.selector_flags(F.col("selector_state"), F.when(F.col("source_index") % 9 == 0, "OTHER").otherwise(F.col("cell_program")), F.col("cell_program"))
    return p.select("source_index", codes(flags).alias("codes"), ((F.col("quality") == "ready") & (F.col("selector_state") != "ambiguous")).alias("passes"))


@query("evidence_merge", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'A:block' ELSE 'A:warn' END || CASE WHEN event_id % 2 = 0 THEN ',B:info' ELSE '' END AS codes, event_type = 'error' AS blocked FROM events")
def _(spark, d):
    e = A.table(spark, d, "events")
    a = F.when(F.col("event_type") == "error", F.array(evidence("A", "block"), evidence("A", "block"))).otherwise(F.array(evidence("A", "warn")))
    flags = O.merged(a, flag_when(F.col("event_id") % 2 == 0, evidence("B", "info")), a)
    return e.select("event_id", codes(flags).alias("codes"), blocked(flags).alias("blocked"))


NEIGHBOURS = ", masked AS (SELECT roll_no, program, pos AS place, substr(roll_no, 1, CAST(pos - 1 AS INTEGER)) || '_' || substr(roll_no, CAST(pos + 1 AS INTEGER)) AS mask FROM roster, range(1, 9) t(pos) WHERE pos <= length(roll_no)), nb AS (SELECT a.roll_no, b.roll_no AS neighbour, CAST(a.place AS INTEGER) AS place, a.program FROM masked a JOIN masked b ON a.program = b.program AND a.mask = b.mask AND a.roll_no <> b.roll_no) "


@query("near_neighbours", A.sql("roster", NEIGHBOURS + "SELECT * FROM nb"))
def _(spark, d):
    return O.near_neighbours(A.roster(spark, d))


@query("near_neighbour_guard", A.sql("roster pages", NEIGHBOURS + """SELECT source_index, roll, count(*) AS neighbours, max(CASE WHEN own IS NULL THEN 'NEAR_NEIGHBOUR_EVIDENCE_MISSING' WHEN own < 0.85 THEN 'NEAR_NEIGHBOUR_HOLD' END) AS code
 FROM (SELECT p.source_index, p.cell_roll AS roll, CASE WHEN source_index % 7 = place - 1 THEN NULL ELSE ((source_index * 7 + place * 11) % 100) / 100.0::DOUBLE END AS own FROM pages p JOIN nb ON p.cell_roll = nb.roll_no) GROUP BY 1, 2"""))
def _(spark, d):
    p = A.pages(spark, d)
    place = lambda i: i + 1
    probs = F.transform(F.sequence(F.lit(0), F.length("cell_roll") - 1), lambda i: F.when(F.col("source_index") % 7 != i, F.create_map(F.substring(F.col("cell_roll"), place(i), F.lit(1)), ((F.col("source_index") * 7 + place(i) * 11) % 100) / 100.0)))
    # a digit with probability 0 and no neighbour's reading is no evidence; the SQL has it as a hold
    guarded = O.neighbour_guard(p.select("source_index", F.col("cell_roll").alias("roll"), F.transform(probs, lambda m: F.when(m.isNotNull(), F.transform_values(m, lambda k, v: F.greatest(v, F.lit(1e-9))))).alias("probs")), O.neighbour_lists(A.roster(spark, d)))
    return guarded


PATHS = f""", cur AS (SELECT *, {CURRENT} AS current_roll FROM pages),
b AS (SELECT o.bubble_roll AS roll, o.source_index AS page1, c.source_index AS continuation, c.sheet_page, c.cell_min, c.cell_program, c.selector_state FROM cur o JOIN cur c ON o.bubble_roll = c.cell_roll WHERE o.sheet_page = 1 AND c.sheet_page > 1 AND c.cell_min >= 0.25 AND NOT coalesce(c.current_roll = o.bubble_roll, FALSE)),
c AS (SELECT o.cell_roll AS roll, o.source_index AS page1, c.source_index AS continuation, c.sheet_page, c.cell_min, c.cell_program, c.selector_state FROM cur o JOIN cur c ON o.cell_roll = c.cell_roll WHERE o.sheet_page = 1 AND o.cell_min >= 0.30 AND (o.bubble_roll IS NULL OR o.bubble_roll <> o.cell_roll) AND c.sheet_page > 1 AND c.cell_min >= 0.30 AND NOT coalesce(c.current_roll = o.cell_roll, FALSE) AND NOT EXISTS (SELECT 1 FROM b WHERE b.roll = o.cell_roll AND b.page1 = o.source_index AND b.continuation = c.source_index)),
both_paths AS (SELECT 'B' AS path, * FROM b UNION ALL SELECT 'C', * FROM c),
slots AS (SELECT cell_roll AS roll, sheet_page, count(*) AS slot_claims FROM cur GROUP BY 1, 2), bub AS (SELECT bubble_roll AS roll, count(*) AS bubble_claims FROM cur WHERE sheet_page = 1 AND bubble_roll IS NOT NULL GROUP BY 1),
cand AS (SELECT path, roll, page1, continuation, sheet_page, (coalesce(slot_claims, 0) <> 1 OR (path = 'B' AND coalesce(bubble_claims, 0) <> 1) OR path = 'C' OR selector_state = 'ambiguous' OR (selector_state = 'blank' AND cell_program <> 'BTECH')) AS blocked, cell_min FROM both_paths LEFT JOIN slots USING (roll, sheet_page) LEFT JOIN bub USING (roll)),
told AS (SELECT *, path = 'B' AND cell_min >= 0.8 AND NOT blocked AS eligible FROM cand)
"""


@query("path_b_candidates", A.sql("pages", PATHS + "SELECT roll, page1, continuation FROM b"))
def _(spark, d):
    return O.path_b(current(spark, d)).select("roll", "page1", "continuation")


@query("path_c_candidates", A.sql("pages", PATHS + "SELECT roll, page1, continuation FROM c"))
def _(spark, d):
    p = current(spark, d)
    return O.path_c(p).select("roll", "page1", "continuation")


@query("candidate_order", A.sql("pages", PATHS + "SELECT path, roll, page1, continuation, sheet_page, blocked, eligible, substr(sha256('v1|' || path || '|' || roll || '|' || page1 || '|' || continuation || '|' || sheet_page), 1, 20) AS candidate_id FROM told"))
def _(spark, d):
    return O.candidates(current(spark, d)).orderBy("blocked", ~F.col("eligible"), "roll", "sheet_page", "continuation")


@query("resolver_counts", A.sql("pages", PATHS + "SELECT count(*) AS candidates, count(*) FILTER (eligible) AS eligible, count(*) FILTER (blocked) AS blocked, (SELECT count(*) FROM cur) AS pages, (SELECT count(*) FROM cur WHERE current_roll IS NOT NULL) AS attached, (SELECT count(*) FROM cur WHERE current_roll IS NULL AND source_index NOT IN (SELECT page1 FROM told UNION SELECT continuation FROM told)) AS unmatched FROM told"))
def _(spark, d):
    p, c = current(spark, d), O.candidates(current(spark, d))
    named = c.select(F.explode(F.array("page1", "continuation")).alias("source_index")).distinct()
    rest = p.where("current_roll IS NULL").join(named, "source_index", "left_anti").agg(F.count("*").alias("unmatched"))
    one = c.agg(F.count("*").alias("candidates"), F.count_if("eligible").alias("eligible"), F.count_if("blocked").alias("blocked"))
    return one.join(p.agg(F.count("*").alias("pages"), F.count("current_roll").alias("attached"))).join(rest)


@query("roster_decode_top1", A.sql("roster", """, reads AS (SELECT student_key AS id, regexp_replace(roll_no, '^(PHD|MT)', '') AS dg FROM roster WHERE student_key % 30 = 7),
 sc AS (SELECT r.id, s.roll_no, length(r.dg) AS size, s.d, r.dg FROM reads r JOIN (SELECT roll_no, regexp_replace(roll_no, '^(PHD|MT)', '') AS d FROM roster) s ON length(s.d) = length(r.dg)),
 l AS (SELECT id, roll_no, size, sum(CASE WHEN substr(d, CAST(pos AS INTEGER), 1) = substr(dg, CAST(pos AS INTEGER), 1) THEN ln(0.82::DOUBLE) ELSE ln(0.02::DOUBLE) END) AS logs FROM sc, range(1, 8) t(pos) WHERE pos <= size GROUP BY 1, 2, 3),
 r AS (SELECT id, roll_no, exp(logs / size) AS score, row_number() OVER w AS place, lead(exp(logs / size)) OVER w AS second FROM l WINDOW w AS (PARTITION BY id ORDER BY floor(exp(logs / size) * 1e6 + 0.5) DESC, roll_no))
 SELECT id, roll_no, floor(score * 1e6 + 0.5) / 1e6 AS score, score >= 0.62 AND score - coalesce(second, 0) >= 0.12 AS clear FROM r WHERE place = 1"""))
def _(spark, d):
    return decoded(spark, d, "student_key % 30 = 7")


@query("roster_decode_all", S["roster_decode_top1"].replace(" WHERE student_key % 30 = 7", ""))
def _(spark, d):
    return decoded(spark, d, "TRUE")


def decoded(spark, d, which):
    r = A.roster(spark, d)
    digits = F.split(F.regexp_replace("roll_no", "^(PHD|MT)", ""), "(?!^)(?!$)")
    probs = F.transform(digits, lambda c: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == c.cast("int"), 0.82).otherwise(0.02)))
    told = O.decode_against_roster(r.where(which).select(F.col("student_key").alias("id"), probs.alias("probs")), r)
    return told.select("id", "roll_no", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "clear")


@query("order_offset_pairs", A.sql("pages", f", cur AS (SELECT *, {CURRENT} AS current_roll FROM pages) SELECT a.bubble_roll AS roll, a.source_index AS page1, c.source_index AS source, CAST(c.sheet_page AS INTEGER) AS slot FROM cur a JOIN cur c ON c.source_index = a.source_index + c.sheet_page - 1 WHERE a.sheet_page = 1 AND a.bubble_roll IS NOT NULL AND c.sheet_page > 1 AND c.current_roll IS NULL"))
def _(spark, d):
    return O.order_suggestions(current(spark, d), "sheet-major", 3, 3000)


@query("scan_order_inference", A.sql("pages", "SELECT *, 'unknown' AS mode FROM (SELECT count(*) AS pages, avg(CAST(sheet_page = (source_index - 1) % 3 + 1 AS INTEGER)) AS sheet_major, avg(CAST(sheet_page = floor((source_index - 1) / 1000.0::DOUBLE) + 1 AS INTEGER)) AS page_major FROM pages)"))
def _(spark, d):
    return O.infer_order(A.pages(spark, d), 3, 3000)


@query("occupied_slots", A.sql("pages", f", cur AS (SELECT *, {CURRENT} AS current_roll FROM pages) SELECT current_roll, sheet_page, count(DISTINCT source_index) AS held, min(source_index) AS first FROM cur WHERE current_roll IS NOT NULL GROUP BY 1, 2"))
def _(spark, d):
    return O.occupied(current(spark, d)).select("current_roll", "sheet_page", F.size("sources").cast("long").alias("held"), F.get("sources", F.lit(0)).alias("first"))


@query("order_attachment_audit", A.sql("roster pages", f", cur AS (SELECT *, {CURRENT} AS current_roll FROM pages), j AS (SELECT CASE WHEN cell_roll = current_roll THEN 'agree' WHEN k.roll_no IS NOT NULL THEN 'contradict_valid_roster' ELSE 'contradict_nonroster' END AS outcome FROM cur LEFT JOIN (SELECT DISTINCT roll_no FROM roster WHERE student_key % 3 <> 0) k ON cell_roll = k.roll_no WHERE sheet_page > 1 AND current_roll IS NOT NULL) SELECT o.outcome, count(j.outcome) AS n FROM (VALUES ('agree'), ('unreadable'), ('contradict_valid_roster'), ('contradict_nonroster')) o(outcome) LEFT JOIN j USING (outcome) GROUP BY 1"))
def _(spark, d):
    return O.audit_order(current(spark, d), A.roster(spark, d).where("student_key % 3 <> 0"))


FOLD = """, sets AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS place FROM decisions WHERE action <> 'assign_source'),
asg AS (SELECT entity, count(DISTINCT slot) AS assigned FROM decisions WHERE action = 'assign_source' GROUP BY entity),
state AS (SELECT e.entity, decisions, coalesce(CASE s.action WHEN 'verify' THEN 'verified' WHEN 'approve' THEN 'approved' WHEN 'hold' THEN 'needs_review' WHEN 'reject' THEN 'rejected' END, 'needs_review') AS status, s.seq AS decided, coalesce(assigned, 0) AS assigned, coalesce(s.action IN ('verify', 'approve'), FALSE) AS eligible
 FROM (SELECT entity, count(*) AS decisions FROM decisions GROUP BY entity) e LEFT JOIN (SELECT * FROM sets WHERE place = 1) s USING (entity) LEFT JOIN asg USING (entity))
"""


@query("decision_fold", A.sql("decisions", FOLD + "SELECT * FROM state"))
def _(spark, d):
    return R.fold(A.decisions(spark, d))


@query("latest_decision", A.sql("decisions", "SELECT entity, action, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS place FROM decisions) WHERE place = 1"))
def _(spark, d):
    return R.latest(A.decisions(spark, d), ["entity"], ["ts", "seq"]).select("entity", "action", "seq", "n")


@query("status_pivot", A.sql("decisions", FOLD + "SELECT k.status, count(s.entity) AS n FROM (VALUES ('verified'), ('approved'), ('needs_review'), ('rejected'), ('missing_pages')) k(status) LEFT JOIN state s USING (status) GROUP BY 1"))
def _(spark, d):
    return R.counted(R.fold(A.decisions(spark, d)), "status", ["verified", "approved", "needs_review", "rejected", "missing_pages"])


@query("best_page", A.sql("pages", "SELECT student_key, sheet_page, source_index, duplicates FROM (SELECT *, row_number() OVER (PARTITION BY student_key, sheet_page ORDER BY CASE bubble_confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, cell_min DESC, source_index) AS place, count(*) OVER (PARTITION BY student_key, sheet_page) - 1 AS duplicates FROM pages) WHERE place = 1"))
def _(spark, d):
    return R.best_page(A.pages(spark, d), ["student_key", "sheet_page"]).select("student_key", "sheet_page", "source_index", "duplicates")


SELECTED = """, manual AS (SELECT n AS entity, slot, seq AS source, seq FROM decisions WHERE action = 'assign_source'),
both_rows AS (SELECT student_key AS entity, sheet_page AS slot, source_index AS source, FALSE AS manual, 0 AS seq FROM pages UNION ALL SELECT entity, slot, source, TRUE, seq FROM manual),
sel AS (SELECT entity, slot, source, manual FROM (SELECT *, row_number() OVER (PARTITION BY entity, slot ORDER BY manual DESC, seq DESC, source DESC) AS place FROM both_rows) WHERE place = 1)
"""


def selected(spark, d):
    parsed = A.pages(spark, d).select(F.col("student_key").alias("entity"), F.col("sheet_page").alias("slot"), F.col("source_index").alias("source"))
    manual = A.decisions(spark, d).where("action = 'assign_source'").select(F.col("n").cast("long").alias("entity"), "slot", F.col("seq").alias("source"), "seq")
    return R.selected_pages(parsed, manual)


@query("manual_override", A.sql("decisions pages", SELECTED + "SELECT * FROM sel"))
def _(spark, d):
    return selected(spark, d)


@query("missing_pages", A.sql("decisions pages", SELECTED + "SELECT entity, array_to_string(list_filter([1, 2, 3], lambda x: NOT list_contains(list(DISTINCT slot), x)), ',') AS missing FROM sel GROUP BY entity"))
def _(spark, d):
    return R.missing_slots(selected(spark, d), 3).select("entity", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("snapshot_digest", A.sql("decisions pages", SELECTED + "SELECT entity, sha256(string_agg(slot || ':' || source, ',' ORDER BY slot, source)) AS digest FROM sel GROUP BY entity"))
def _(spark, d):
    return R.selection_hash(selected(spark, d))


@query("stale_grades", A.sql("decisions pages", SELECTED + """, cur AS (SELECT entity, sha256(string_agg(slot || ':' || source, ',' ORDER BY slot, source)) AS digest FROM sel GROUP BY entity), old AS (SELECT student_key AS entity, sha256(string_agg(sheet_page || ':' || source_index, ',' ORDER BY sheet_page, source_index)) AS digest, count(*) AS score FROM (SELECT *, row_number() OVER (PARTITION BY student_key, sheet_page ORDER BY source_index DESC) AS p FROM pages) WHERE p = 1 GROUP BY 1)
 SELECT entity, NOT coalesce(cur.digest = old.digest, FALSE) AS stale, CASE WHEN cur.digest = old.digest THEN score END AS score FROM old LEFT JOIN cur USING (entity)"""))
def _(spark, d):
    parsed = A.pages(spark, d).select(F.col("student_key").alias("entity"), F.col("sheet_page").alias("slot"), F.col("source_index").alias("source"))
    before = R.latest(parsed, ["entity", "slot"], ["source"])
    graded = R.selection_hash(before).join(before.groupBy("entity").agg(F.count("*").alias("score")), "entity")
    return R.stale(R.selection_hash(selected(spark, d)), graded)


@query("gradable_sheets", A.sql("decisions pages", SELECTED + FOLD.replace(", sets", ", sets") + """, cl AS (SELECT source, count(*) AS claims FROM sel GROUP BY 1), by_e AS (SELECT entity, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS slots, max(claims) AS claims FROM sel JOIN cl USING (source) GROUP BY 1)
 SELECT s.entity, coalesce(status IN ('auto_matched', 'approved', 'verified') AND slots = '1,2,3' AND claims = 1, FALSE) AS gradable FROM state s LEFT JOIN by_e USING (entity)"""))
def _(spark, d):
    return R.gradable(selected(spark, d), R.fold(A.decisions(spark, d)), 3)


@query("selection_conflicts", A.sql("decisions", "SELECT n AS source, count(DISTINCT entity) AS owners FROM decisions WHERE action = 'assign_source' GROUP BY n HAVING count(DISTINCT entity) > 1"))
def _(spark, d):
    return R.conflicts(A.decisions(spark, d).where("action = 'assign_source'").select(F.col("n").alias("source"), "entity"))


@query("one_owner", A.sql("decisions", "SELECT seq, n AS source, first_value(entity) OVER w AS owner, entity <> first_value(entity) OVER w AS displaced FROM decisions WHERE action = 'assign_source' WINDOW w AS (PARTITION BY n ORDER BY ts DESC, seq DESC)"))
def _(spark, d):
    a = A.decisions(spark, d).where("action = 'assign_source'").select(F.col("n").alias("source"), "entity", "ts", "seq")
    return R.one_owner(a).select("seq", "source", "owner", "displaced")


@query("protected_reassess", A.sql("roster decisions", "SELECT student_key AS entity, program FROM roster WHERE student_key NOT IN (SELECT entity FROM decisions)"))
def _(spark, d):
    return R.unprotected(A.roster(spark, d).select(F.col("student_key").alias("entity"), "program"), A.decisions(spark, d))


@query("roster_reconciliation", A.sql("roster pages", "SELECT coalesce(e.roll_no, f.cell_roll) AS roll_no, CASE WHEN f.cell_roll IS NULL THEN 'missing' WHEN e.roll_no IS NULL THEN 'unexpected' ELSE 'matched' END AS status FROM (SELECT DISTINCT roll_no FROM roster WHERE student_key % 8 <> 0) e FULL JOIN (SELECT DISTINCT cell_roll FROM pages WHERE source_index % 2 = 0) f ON e.roll_no = f.cell_roll"))
def _(spark, d):
    return R.reconcile(A.roster(spark, d).where("student_key % 8 <> 0"), A.pages(spark, d).where("source_index % 2 = 0").withColumnRenamed("cell_roll", "roll_no"), "roll_no")


@query("roster_missing", A.sql("roster pages", "SELECT DISTINCT roll_no FROM roster WHERE roll_no NOT IN (SELECT cell_roll FROM pages WHERE source_index % 2 = 0)"))
def _(spark, d):
    return A.roster(spark, d).select("roll_no").distinct().join(A.pages(spark, d).where("source_index % 2 = 0").select(F.col("cell_roll").alias("roll_no")), "roll_no", "left_anti")


@query("roster_unexpected", A.sql("roster pages", "SELECT DISTINCT cell_roll AS roll_no FROM pages WHERE cell_roll NOT IN (SELECT roll_no FROM roster WHERE student_key % 8 <> 0)"))
def _(spark, d):
    return A.pages(spark, d).select(F.col("cell_roll").alias("roll_no")).distinct().join(A.roster(spark, d).where("student_key % 8 <> 0").select("roll_no"), "roll_no", "left_anti")


@query("known_rolls", A.sql("roster pages", "SELECT DISTINCT upper(trim(r)) AS roll FROM (SELECT roll_no AS r FROM roster UNION ALL SELECT bubble_roll FROM pages) WHERE r IS NOT NULL AND trim(r) <> ''"))
def _(spark, d):
    both = A.roster(spark, d).select(F.col("roll_no").alias("r")).unionByName(A.pages(spark, d).select(F.col("bubble_roll").alias("r")))
    return both.select(F.upper(F.trim("r")).alias("roll")).where("roll <> ''").distinct()


@query("release_queue", A.sql("roster decisions", FOLD + ", st AS (SELECT r.student_key, r.roll_no, CASE WHEN r.student_key % 9 = 0 THEN '' ELSE email END AS email, s.status, s.eligible, r.student_key % 11 <> 0 AS has_pdf FROM roster r JOIN state s ON r.student_key = s.entity) SELECT student_key, roll_no FROM st WHERE email <> '' AND eligible AND status NOT IN ('needs_review', 'missing_pages', 'rejected') AND has_pdf"))
def _(spark, d):
    return R.release(releasable(spark, d))[0].select("student_key", "roll_no")


def releasable(spark, d):
    r = A.roster(spark, d).withColumn("email", F.when(F.col("student_key") % 9 == 0, "").otherwise(F.col("email"))).withColumn("has_pdf", F.col("student_key") % 11 != 0)
    return r.join(R.fold(A.decisions(spark, d)), F.col("student_key") == F.col("entity"))


@query("release_skipped", A.sql("roster decisions", FOLD + ", st AS (SELECT r.student_key, CASE WHEN r.student_key % 9 = 0 THEN '' ELSE email END AS email, s.status, s.eligible, r.student_key % 11 <> 0 AS has_pdf FROM roster r JOIN state s ON r.student_key = s.entity) SELECT student_key, reason FROM (SELECT student_key, CASE WHEN email = '' THEN 'missing_email' WHEN NOT eligible THEN 'not_eligible' WHEN status IN ('needs_review', 'missing_pages', 'rejected') THEN 'status_' || status WHEN NOT has_pdf THEN 'missing_pdf' END AS reason FROM st) WHERE reason IS NOT NULL"))
def _(spark, d):
    return R.release(releasable(spark, d))[1].select("student_key", "reason")


@query("sent_anti_join", A.sql("roster", "SELECT student_key, roll_no FROM roster WHERE student_key % 5 <> 0"))
def _(spark, d):
    r = A.roster(spark, d)
    log = r.select("roll_no", F.upper("email").alias("email"), F.when(F.col("student_key") % 5 == 0, "SENT").otherwise("DRY_RUN").alias("status"))
    return R.not_sent(r, log).select("student_key", "roll_no")


@query("queue_limit", A.sql("roster", "SELECT student_key, roll_no FROM roster ORDER BY roll_no, student_key LIMIT 25"))
def _(spark, d):
    return A.roster(spark, d).orderBy("roll_no", "student_key").limit(25).select("student_key", "roll_no")


@query("next_in_queue", A.sql("roster", "SELECT roll_no, centre, lead(roll_no) OVER (PARTITION BY centre ORDER BY roll_no) AS next_roll FROM roster"))
def _(spark, d):
    return R.next_in_queue(A.roster(spark, d)).select("roll_no", "centre", "next_roll")


@query("queue_filter", A.sql("roster decisions", FOLD + "SELECT roll_no FROM roster JOIN state ON student_key = entity WHERE status = 'needs_review' AND contains(lower(roll_no || ' ' || name), 'mt')"))
def _(spark, d):
    j = A.roster(spark, d).join(R.fold(A.decisions(spark, d)), F.col("student_key") == F.col("entity"))
    return j.where(R.queue_matches("review", F.col("status"), F.lit(0), "MT", F.concat_ws(" ", "roll_no", "name"))).select("roll_no")


@query("rejection_reasons", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'duplicate_claim' WHEN 1 THEN 'missing_counterpart' WHEN 2 THEN 'program_mismatch' WHEN 3 THEN 'low_identity_confidence' ELSE 'other_page_' || (o_orderkey % 3 + 1) END AS reason, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "Duplicate page-2; low confidence").when(k % 5 == 1, "MISSING PAGE 3").when(k % 5 == 2, "roll does not match the verified page-1 program").when(k % 5 == 3, "Low confidence read").otherwise("none")
    return A.table(spark, d, "orders").groupBy(R.rejection_reason(text, k % 3 + 1).alias("reason")).agg(F.count("*").alias("n"))


#: Wordings of readers and checks, of which a page has two.
WORDS = [
    "Duplicate page-2 claim", "Missing page 3", "missing counterpart", "No page-1 sheet has the same roll", "Roll does not match the verified page-1 program", "Fields produced conflicting candidates", "Digits could not be decoded confidently",
    "Cells did not produce a valid roll", "Low confidence read", "Requires manual confirmation", "Continuation program selector is blank", "Continuation program selector is ambiguous", "Program selector is blank", "Orientation marker missing", "Could not validate", "conflicts with strip", "unreadable", "whole-strip OCR differs", "none",
]
REJECTED = f"""WITH w AS (SELECT {WORDS!r} AS w), p AS (SELECT o_orderkey AS k, lower(w[o_orderkey % 19 + 1] || ' | ' || w[o_orderkey // 7 % 19 + 1]) AS bar, lower(w[o_orderkey % 19 + 1] || ' ' || w[o_orderkey // 7 % 19 + 1]) AS gap, CASE o_orderkey % 3 WHEN 0 THEN 'BTECH' WHEN 1 THEN 'MTECH' END AS program, CASE WHEN o_orderkey % 4 <> 0 THEN '2000001' WHEN o_orderkey % 8 = 0 THEN '' END AS roll, o_orderkey % 5 AS page FROM orders, w)"""


@query("page_rejections", REJECTED + """ SELECT CASE WHEN contains(bar, 'duplicate page-') THEN 'duplicate_claim' WHEN contains(bar, 'missing page') OR contains(bar, 'missing counterpart') THEN 'missing_counterpart' WHEN contains(bar, 'no page-1 sheet has the same roll') THEN 'no_verified_page1_anchor'
 WHEN contains(bar, 'does not match the verified page-1 program') THEN 'program_mismatch' WHEN contains(bar, 'produced conflicting candidates') THEN 'cell_strip_or_field_conflict' WHEN contains(bar, 'could not be decoded confidently') OR contains(bar, 'did not produce a valid roll') THEN 'no_literal_roll'
 WHEN contains(bar, 'low confidence') OR contains(bar, 'requires manual confirmation') THEN 'low_identity_confidence' WHEN contains(bar, 'continuation program selector is blank') OR (NOT contains(bar, 'continuation program selector is ambiguous') AND contains(bar, 'program selector is blank')) THEN CASE WHEN program = 'BTECH' THEN 'blank_selector_btech' ELSE 'blank_selector_postgraduate' END
 WHEN coalesce(roll, '') = '' THEN 'no_literal_roll' ELSE 'other_page_' || CASE WHEN page = 0 THEN 'unknown' ELSE CAST(page AS VARCHAR) END END AS reason, count(*) AS n FROM p GROUP BY 1""")
def _(spark, d):
    p = rejected(spark, d)
    return p.groupBy(R.page_rejection(F.col("flags"), F.col("page"), F.col("program"), F.col("roll")).alias("reason")).agg(F.count("*").alias("n"))


@query("unmatched_tally", REJECTED + """ SELECT CASE WHEN contains(gap, 'duplicate') THEN 'duplicate_claim' WHEN contains(gap, 'orientation marker') OR contains(gap, 'could not validate') THEN 'inspection_or_alignment_failure' WHEN contains(gap, 'program selector') THEN CASE WHEN program = 'BTECH' THEN 'program_selector_btech' ELSE 'program_selector_postgraduate' END
 WHEN contains(gap, 'conflicting candidates') OR contains(gap, 'conflicts with') THEN 'conflicting_identity' WHEN contains(gap, 'could not be decoded') OR contains(gap, 'did not produce') OR contains(gap, 'unreadable') THEN 'unreadable_roll' WHEN contains(gap, 'low confidence') OR contains(gap, 'whole-strip') THEN 'low_resnet_confidence'
 WHEN contains(gap, 'no page-1 sheet') OR contains(gap, 'missing page') THEN 'missing_counterpart' ELSE 'other' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def _(spark, d):
    return rejected(spark, d).groupBy(R.unmatched_reason(F.col("flags"), F.col("program")).alias("reason")).agg(F.count("*").alias("n"))


def rejected(spark, d):
    k, words = F.col("o_orderkey"), F.array(*map(F.lit, WORDS))
    flags = F.array(F.get(words, (k % 19).cast("int")), F.get(words, F.expr("cast(o_orderkey div 7 % 19 as int)")))
    return A.table(spark, d, "orders").select(flags.alias("flags"), F.when(k % 3 == 0, "BTECH").when(k % 3 == 1, "MTECH").alias("program"), F.when(k % 4 != 0, "2000001").when(k % 8 == 0, "").alias("roll"), (k % 5).alias("page"))


@query("evidence_cache_reuse", "SELECT p.page_id, c.first IS NOT NULL AS hit, c.first AS evidence FROM (SELECT page_id, sha256(html) AS digest FROM pages) p LEFT JOIN (SELECT sha256(html) AS digest, min(page_id) AS first FROM pages WHERE page_id % 3 = 0 GROUP BY 1) c USING (digest)")
def _(spark, d):
    p = A.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    cache = p.where("page_id % 3 = 0").groupBy("digest").agg(F.min("page_id").alias("evidence"))
    return R.reused(p, cache).select("page_id", "hit", "evidence")


@query("file_digest", "SELECT page_id, sha256(html) AS digest, length(html) AS size FROM pages")
def _(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.length("html").cast("long").alias("size"))


@query("inventory_progress", A.sql("pages", "SELECT k.quality, count(p.quality) AS n FROM (VALUES ('ready'), ('needs_review'), ('failed'), ('pending')) k(quality) LEFT JOIN pages p USING (quality) GROUP BY 1"))
def _(spark, d):
    return R.counted(A.pages(spark, d), "quality", ["ready", "needs_review", "failed", "pending"])


@query("marks_label", A.sql("decisions", FOLD + "SELECT entity, CASE WHEN decisions % 7 = 0 THEN 'stale' WHEN eligible THEN 'graded' WHEN assigned > 2 THEN 'changed' WHEN status <> 'verified' AND decisions < 10 THEN 'incomplete' ELSE 'not graded' END AS label FROM state"))
def _(spark, d):
    s = R.fold(A.decisions(spark, d))
    return s.select("entity", R.marks_label(F.col("decisions") % 7 == 0, F.col("eligible"), F.col("assigned") > 2, ~((F.col("status") != "verified") & (F.col("decisions") < 10))).alias("label"))


@query("page_assignment", A.sql("pages", f", cur AS (SELECT *, {CURRENT} AS current_roll FROM pages) SELECT o.o_orderkey + 1 AS source_index, coalesce(max(current_roll), 'unassigned') AS owner, max(CASE WHEN c.source_index IS NULL THEN 'pending' WHEN quality = 'ready' THEN 'aligned' ELSE quality END) AS status FROM orders o LEFT JOIN cur c ON c.source_index = o.o_orderkey + 1 GROUP BY 1"))
def _(spark, d):
    inventory = A.table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("source_index"))
    j = inventory.join(current(spark, d), "source_index", "left")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == "ready", "aligned").otherwise(F.col("quality"))
    return j.groupBy("source_index").agg(F.coalesce(F.max("current_roll"), F.lit("unassigned")).alias("owner"), F.max(status).alias("status"))
