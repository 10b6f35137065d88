"""Review commands (T1) on a log made of the events: an exam for each user, a command for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import commands as C
from gradeloom.plans import adapters as A

Q: dict = {}
S: dict = {}
EXPECTED = 3


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def review_log(spark: SparkSession, d: str) -> DataFrame:
    """Twelve pages of four students in each exam, every fourth unmatched, then a command for each event."""
    e = A.table(spark, d, "events").where("user_id IS NOT NULL")
    exam, seq = F.col("user_id"), F.col("event_id")
    none = lambda kind: F.lit(None).cast(kind)
    roll = lambda r: F.concat(F.lit("20"), F.lpad(((F.col("user_id") * 5 + r) % 100000).cast("string"), 5, "0"))
    i = F.col("i")
    pages = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"))
    found = pages.select(
        exam.alias("exam"), (i - 1000000).cast("long").alias("seq"), F.lit("found").alias("action"), i.cast("long").alias("source"), F.when(i % 4 != 0, roll(F.expr("(i - 1) div 3"))).alias("roll"), ((i - 1) % 3 + 1).cast("int").alias("slot"),
        none("boolean").alias("replace"), none("string").alias("note"), (i % 11 != 10).alias("image"), none("string").alias("candidate"), none("long").alias("page_one"), none("long").alias("continuation"), none("string").alias("assigned"),
        none("boolean").alias("allow_missing"), none("boolean").alias("in_roster"), F.lit(EXPECTED).alias("expected"),
    )
    k, h, r = F.col("k"), F.col("h"), F.col("r")
    action = (
        F.when(h <= 1, "assign").when(h == 2, "assign_unmatched").when(h == 3, F.when(k % 4 == 0, "ignore").otherwise("hold")).when(h == 4, "verify").when(h == 5, F.when(k % 5 == 0, "reject").otherwise("approve_page1"))
        .when(h == 6, F.when(k % 2 == 0, "approve").otherwise("approve_page2")).otherwise(F.when(k % 3 == 0, "reject_suggestion").otherwise("assign_suggestion"))
    )
    c = e.withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))).withColumn("h", seq % 8).withColumn("r", F.expr("event_id div 8 % 5"))
    other = (r + 1) % 5
    told = c.select(
        exam.alias("exam"), seq.alias("seq"), action.alias("action"), (k % 13 + 1).cast("long").alias("source"), F.when(k % 17 == 0, "XX").otherwise(roll(r)).alias("roll"), F.when(k % 5 != 0, k % 5).alias("slot"),
        (h == 1).alias("replace"), F.when(k % 19 == 0, " ").otherwise("checked").alias("note"), none("boolean").alias("image"), (seq % 7).cast("string").alias("candidate"), (k % 13 + 1).cast("long").alias("page_one"), ((k + 5) % 13 + 1).cast("long").alias("continuation"),
        F.when(k % 11 != 0, roll(other)).alias("assigned"), (k % 3 == 0).alias("allow_missing"), (F.when((h == 7) & (k % 3 != 0), other).otherwise(r) != 4).alias("in_roster"), F.lit(EXPECTED).alias("expected"),
    )
    return found.unionByName(told)


def _replay() -> str:
    """The log replayed by a recursion over its commands, one row of lists for each exam and step."""
    roll = lambda r: f"'20' || lpad(CAST((user_id * 5 + {r}) % 100000 AS VARCHAR), 5, '0')"
    holders = lambda s: f"list_transform(list_filter(list_concat(parsed, manual), lambda x: x.source = {s}), lambda x: x.roll)"
    owner = lambda s: f"list_min({holders(s)})"
    record = lambda s: f"list_filter(src, lambda x: x.source = {s})[1]"
    known = "(in_roster OR list_contains(list_transform(students, lambda x: x.roll), target))"
    full = "len(list_distinct(list_filter(list_transform(list_filter(list_concat(parsed, manual), lambda y: y.roll = x.roll), lambda y: y.slot), lambda y: y BETWEEN 1 AND 3))) = 3"
    put = lambda s, p: f"{{'roll': target, 'source': {s}, 'slot': {p}}}"
    given = lambda s, p: f"list_transform(src, lambda x: CASE WHEN x.source = {s} AND x.status IS NOT NULL THEN {{'source': x.source, 'slot': x.slot, 'image': x.image, 'status': 'assigned', 'roll': target, 'page': {p}}} ELSE x END)"
    ensured = "CASE WHEN list_contains(list_transform(students, lambda x: x.roll), target) THEN students ELSE list_append(students, {'roll': target, 'status': 'needs_review'}) END"

    def move(s: str, p: str, mark: str, before: str) -> str:
        """A suggested page goes to the target, unless the target holds it first already."""
        away = f"ok{mark} AND {s} IS NOT NULL AND {owner(s)} IS DISTINCT FROM target"
        return f"""SELECT * REPLACE (CASE WHEN go{mark} THEN list_filter(parsed, lambda x: NOT (x.source = {s} AND x.roll <> target)) ELSE parsed END AS parsed,
   CASE WHEN go{mark} THEN list_append(list_filter(manual, lambda x: NOT (x.source = {s} AND x.roll <> target) AND NOT (x.roll = target AND (x.source = {s} OR x.slot = {p}))), {put(s, p)}) ELSE manual END AS manual,
   CASE WHEN go{mark} THEN list_transform(students, lambda x: CASE WHEN x.roll <> target AND list_contains(held{mark}, x.roll) THEN {{'roll': x.roll, 'status': 'needs_review'}} ELSE x END) ELSE students END AS students,
   CASE WHEN go{mark} THEN {given(s, p)} ELSE src END AS src)
  FROM (SELECT *, {holders(s)} AS held{mark}, {away} AND bad{mark} IS NULL AS go{mark} FROM (SELECT *, CASE WHEN ok{mark} AND {s} IS NOT NULL THEN CASE WHEN {p} IS NULL THEN 'invalid_source' WHEN {record(s)} IS NULL THEN 'unknown_source'
   WHEN {owner(s)} IS DISTINCT FROM target AND {record(s)}.status = 'assigned' AND {record(s)}.roll <> target THEN 'assigned_elsewhere' END END AS bad{mark} FROM ({before})))"""

    looked = f"""SELECT s.exam, s.n + 1 AS n, s.parsed, s.manual, s.src, s.students, s.decided, c.seq, c.action, c.source, c.roll AS target, c.slot, c.replace, c.note, c.candidate, c.in_roster, c.allow_missing, c.m1, c.m2,
   {record("c.source")} AS rec, {owner("c.source")} AS own, s.parsed AS parsed0, s.manual AS manual0, s.src AS src0, s.students AS students0, s.decided AS decided0 FROM st s JOIN cmd c ON s.exam = c.exam AND s.n + 1 = c.n"""
    placed = f"""SELECT *, CASE WHEN action = 'assign' THEN coalesce(slot, CASE WHEN own IS NULL THEN rec.slot ELSE list_filter(list_concat(manual, parsed), lambda x: x.source = source AND x.roll = own)[1].slot END) ELSE coalesce(slot, rec.slot) END AS spot,
   list_contains(list_transform(students, lambda x: x.roll), target) AS there, {full.replace("x.roll", "target")} AS whole FROM ({looked})"""
    pushed = f"SELECT *, list_sort(list_distinct(list_transform(list_filter(list_concat(parsed, manual), lambda x: x.roll = target AND x.slot = spot AND x.source <> source), lambda x: x.source))) AS out FROM ({placed})"
    judged = f"""SELECT *, CASE
   WHEN action IN ('verify', 'hold', 'reject', 'assign_unmatched') AND NOT there THEN 'unknown_student' WHEN action = 'verify' AND NOT whole AND NOT allow_missing THEN 'missing_pages'
   WHEN action IN ('ignore', 'assign_unmatched') AND (rec IS NULL OR rec.status IS NULL) THEN 'unknown_source' WHEN action = 'assign_unmatched' AND rec.status = 'ignored' THEN 'ignored_source' WHEN action = 'assign_unmatched' AND spot <> rec.slot THEN 'no_such_page'
   WHEN action IN ('verify', 'hold', 'reject', 'ignore', 'assign_unmatched') THEN NULL WHEN trim(note) = '' THEN 'no_note'
   WHEN action = 'assign' THEN CASE WHEN target = 'XX' THEN 'bad_roll' WHEN NOT {known} THEN 'not_in_roster' WHEN rec IS NULL THEN 'unknown_source' WHEN spot NOT BETWEEN 1 AND 3 THEN 'bad_slot' WHEN NOT rec.image THEN 'no_image' WHEN len(out) > 0 AND NOT replace THEN 'slot_taken' END
   WHEN list_contains(decided, candidate) THEN 'suggestion_decided' WHEN action = 'reject_suggestion' THEN NULL WHEN target IS NULL THEN 'no_roll' WHEN NOT {known} THEN 'not_in_roster' END AS early FROM ({pushed})"""
    simple = f"""SELECT * REPLACE (
   CASE WHEN early IS NULL AND action = 'assign' THEN list_filter(parsed, lambda x: x.source <> source AND NOT (x.roll = target AND x.slot = spot)) ELSE parsed END AS parsed,
   CASE WHEN early IS NULL AND action = 'assign' THEN list_append(list_filter(manual, lambda x: x.source <> source AND NOT (x.roll = target AND x.slot = spot)), {put("source", "spot")})
    WHEN early IS NULL AND action = 'assign_unmatched' THEN list_append(list_filter(manual, lambda x: NOT (x.source = source AND x.roll = target)), {put("source", "spot")}) ELSE manual END AS manual,
   CASE WHEN early IS NULL AND action = 'assign' THEN list_transform({given("source", "spot")}, lambda x: CASE WHEN list_contains(out, x.source) THEN {{'source': x.source, 'slot': spot, 'image': x.image, 'status': 'needs_review', 'roll': NULL, 'page': NULL}} ELSE x END)
    WHEN early IS NULL AND action = 'assign_unmatched' THEN {given("source", "spot")}
    WHEN early IS NULL AND action = 'ignore' THEN list_transform(src, lambda x: CASE WHEN x.source = source THEN {{'source': x.source, 'slot': x.slot, 'image': x.image, 'status': 'ignored', 'roll': x.roll, 'page': x.page}} ELSE x END) ELSE src END AS src,
   CASE WHEN early IS NULL AND action = 'assign' THEN list_transform({ensured}, lambda x: CASE WHEN x.roll <> target AND list_contains({holders("source")}, x.roll) THEN {{'roll': x.roll, 'status': 'needs_review'}} ELSE x END)
    WHEN early IS NULL AND suggests AND action <> 'reject_suggestion' THEN {ensured} ELSE students END AS students,
   CASE WHEN early IS NULL AND suggests THEN list_append(decided, candidate) ELSE decided END AS decided),
   early IS NULL AND suggests AND action <> 'reject_suggestion' AS ok1 FROM (SELECT *, action IN ('approve', 'approve_page1', 'approve_page2', 'assign_suggestion', 'reject_suggestion') AS suggests FROM ({judged}))"""
    moved = f"SELECT *, coalesce(early, bad1, bad2) AS reason FROM ({move('m2', 'slot', '2', 'SELECT *, ok1 AND bad1 IS NULL AS ok2 FROM (' + move('m1', '1', '1', simple) + ')')})"
    marked = f"""SELECT *, CASE WHEN reason IS NULL THEN list_transform(students, lambda x: CASE WHEN x.roll = target AND action = 'verify' THEN {{'roll': x.roll, 'status': 'verified'}} WHEN x.roll = target AND action = 'reject' THEN {{'roll': x.roll, 'status': 'rejected'}}
   WHEN x.roll = target AND action NOT IN ('ignore', 'reject_suggestion') THEN {{'roll': x.roll, 'status': 'needs_review'}} ELSE x END) END AS marked FROM ({moved})"""
    step = f"""SELECT exam, n, CASE WHEN reason IS NULL THEN parsed ELSE parsed0 END, CASE WHEN reason IS NULL THEN manual ELSE manual0 END, CASE WHEN reason IS NULL THEN src ELSE src0 END,
   CASE WHEN reason IS NULL THEN list_transform(marked, lambda x: CASE WHEN NOT ({full}) AND x.status NOT IN ('verified', 'rejected') THEN {{'roll': x.roll, 'status': 'missing_pages'}} ELSE x END) ELSE students0 END,
   CASE WHEN reason IS NULL THEN decided ELSE decided0 END, seq, action, reason, CASE WHEN reason IS NULL AND action = 'assign' THEN own END, CASE WHEN reason IS NULL AND action = 'assign' THEN out ELSE [] END FROM ({marked})"""
    h, k, r = "event_id % 8", "k", "event_id // 8 % 5"
    return f"""WITH RECURSIVE ev AS (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events WHERE user_id IS NOT NULL),
 cm AS (SELECT user_id AS exam, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN {h} <= 1 THEN 'assign' WHEN {h} = 2 THEN 'assign_unmatched' WHEN {h} = 3 THEN CASE WHEN k % 4 = 0 THEN 'ignore' ELSE 'hold' END WHEN {h} = 4 THEN 'verify'
  WHEN {h} = 5 THEN CASE WHEN k % 5 = 0 THEN 'reject' ELSE 'approve_page1' END WHEN {h} = 6 THEN CASE WHEN k % 2 = 0 THEN 'approve' ELSE 'approve_page2' END WHEN k % 3 = 0 THEN 'reject_suggestion' ELSE 'assign_suggestion' END AS action,
  CAST({k} % 13 + 1 AS BIGINT) AS source, CASE WHEN {h} = 7 AND k % 3 <> 0 THEN CASE WHEN k % 11 <> 0 THEN {roll(f"({r} + 1) % 5")} END WHEN k % 17 = 0 THEN 'XX' ELSE {roll(r)} END AS roll, nullif(k % 5, 0) AS slot, {h} = 1 AS replace, CASE WHEN k % 19 = 0 THEN ' ' ELSE 'checked' END AS note,
  event_id % 7 AS candidate, CAST(k % 13 + 1 AS BIGINT) AS page_one, CAST((k + 5) % 13 + 1 AS BIGINT) AS continuation, CASE WHEN {h} = 7 AND k % 3 <> 0 THEN ({r} + 1) % 5 <> 4 ELSE {r} <> 4 END AS in_roster, k % 3 = 0 AS allow_missing FROM ev),
 cmd AS (SELECT *, CASE WHEN action IN ('approve', 'approve_page1', 'assign_suggestion') THEN page_one END AS m1, CASE WHEN action IN ('approve', 'approve_page2', 'assign_suggestion') THEN continuation END AS m2 FROM cm),
 pg AS (SELECT user_id AS exam, CAST(i AS BIGINT) AS source, CAST((i - 1) % 3 + 1 AS INTEGER) AS slot, CASE WHEN i % 4 <> 0 THEN {roll("(i - 1) // 3")} END AS roll, i % 11 <> 10 AS image FROM (SELECT DISTINCT user_id FROM ev), range(1, 13) t(i)),
 st(exam, n, parsed, manual, src, students, decided, seq, action, reason, from_roll, displaced) AS (
  SELECT exam, 0::BIGINT, list({{'roll': roll, 'source': source, 'slot': slot}} ORDER BY source) FILTER (roll IS NOT NULL), CAST([] AS STRUCT(roll VARCHAR, source BIGINT, slot INTEGER)[]),
   list({{'source': source, 'slot': slot, 'image': image, 'status': CASE WHEN roll IS NULL THEN 'needs_review' END, 'roll': CAST(NULL AS VARCHAR), 'page': CAST(NULL AS INTEGER)}} ORDER BY source),
   (SELECT list({{'roll': q.roll, 'status': q.status}} ORDER BY q.roll) FROM (SELECT p2.exam, p2.roll, CASE WHEN count(*) = 3 THEN 'auto_matched' ELSE 'missing_pages' END AS status FROM pg p2 WHERE p2.roll IS NOT NULL GROUP BY 1, 2) q WHERE q.exam = pg.exam),
   CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST([] AS BIGINT[]) FROM pg GROUP BY exam
  UNION ALL {step})"""


REPLAY = _replay()


@query("review_commands", REPLAY + " SELECT exam, seq, action, reason IS NULL AS accepted, reason, from_roll, array_to_string(displaced, ',') AS displaced FROM st WHERE n > 0")
def _(spark, d):
    done = C.fold_commands(review_log(spark, d)).where("action <> 'found'")
    return done.select("exam", "seq", "action", "accepted", "reason", "from_roll", F.array_join(F.transform("displaced", lambda x: x.cast("string")), ",").alias("displaced"))


@query(
    "review_state",
    REPLAY
    + """, last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY exam ORDER BY n DESC) = 1), s AS (SELECT exam, unnest(students) AS x, parsed, manual FROM last),
 held AS (SELECT exam, x.roll AS id, x.status AS status, list_concat(list_transform(list_filter(parsed, lambda y: y.roll = x.roll), lambda y: {'slot': y.slot, 'source': y.source}), list_transform(list_filter(manual, lambda y: y.roll = x.roll), lambda y: {'slot': y.slot, 'source': y.source})) AS own FROM s),
 slots AS (SELECT exam, id, status, slot, own, list_filter(own, lambda y: y.slot = slot)[-1].source AS source FROM held, range(0, 5) t(slot))
 SELECT exam, 'student' AS kind, id, any_value(status) AS status, coalesce(string_agg(slot || ':' || source, ',' ORDER BY slot) FILTER (source IS NOT NULL), '') AS pages FROM slots GROUP BY exam, id
 UNION ALL SELECT exam, 'source', CAST(x.source AS VARCHAR), coalesce(x.status, 'held'), CASE WHEN x.roll IS NULL THEN '' ELSE x.roll || ':' || x.page END FROM (SELECT exam, unnest(src) AS x FROM last)""",
)
def _(spark, d):
    return C.review_state(C.fold_commands(review_log(spark, d)))
