"""Review state and reconciliation (W1 to W3, W5, T1, T2, T4 to T6, T8, A4, A14, A20, J8, J9, J15, J16, U*, P15, P16, Z8, Z15, Z19, Z20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"high": 3, "medium": 2, "low": 1}
STATUS_OF = {"verify": "verified", "approve": "approved", "hold": "needs_review", "reject": "rejected"}


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def rank_of(confidence: Column) -> Column:
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(confidence == name, r).otherwise(out)
    return out


def best_page(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Of a slot's pages the surest (ties: the earlier source), with how many others claim it."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc(rank_of(F.col("bubble_confidence"))), F.desc("cell_min"), "source_index")
    told = pages.withColumn("place", F.row_number().over(order)).withColumn("duplicates", F.count("*").over(w) - 1)
    return told.where("place = 1").drop("place")


def selected_pages(parsed: DataFrame, manual: DataFrame) -> DataFrame:
    """Parser pages, overridden slot by slot by the last manual choice."""
    both = parsed.select("entity", "slot", "source", F.lit(False).alias("manual"), F.lit(0).cast("long").alias("seq")).unionByName(manual.select("entity", "slot", "source", F.lit(True).alias("manual"), F.col("seq").cast("long").alias("seq")))
    return latest(both, ["entity", "slot"], ["manual", "seq", "source"]).select("entity", "slot", "source", "manual")


def fold(log: DataFrame) -> DataFrame:
    """The state to which a log of decisions leads.

    Status is that of the last decision that sets one; eligibility falls with hold and reject; each
    slot keeps its last assignment. A window and grouped maxima replace replaying the log.
    """
    sets = log.where(F.col("action").isin(*STATUS_OF))
    status = F.lit(None).cast("string")
    for action, s in STATUS_OF.items():
        status = F.when(F.col("action") == action, F.lit(s)).otherwise(status)
    last = latest(sets, ["entity"], ["ts", "seq"]).select("entity", status.alias("status"), F.col("seq").alias("decided"))
    assigned = latest(log.where("action = 'assign_source'"), ["entity", "slot"], ["ts", "seq"]).groupBy("entity").agg(F.count("*").alias("assigned"))
    every = log.groupBy("entity").agg(F.count("*").alias("decisions"))
    joined = every.join(last, "entity", "left").join(assigned, "entity", "left")
    return joined.select("entity", "decisions", F.coalesce("status", F.lit("needs_review")).alias("status"), "decided", F.coalesce("assigned", F.lit(0)).alias("assigned"), F.coalesce(F.col("status").isin("verified", "approved"), F.lit(False)).alias("eligible"))


def one_owner(assignments: DataFrame) -> DataFrame:
    """A source belongs to the student of its last assignment; others lose it (displaced)."""
    w = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("seq"))
    return assignments.withColumn("owner", F.first("entity").over(w)).withColumn("displaced", F.col("entity") != F.col("owner"))


def missing_slots(selected: DataFrame, expected: int) -> DataFrame:
    """Expected slots less found ones, by student."""
    found = selected.groupBy("entity").agg(F.collect_set("slot").alias("slots"))
    return found.select("entity", F.array_except(F.sequence(F.lit(1), F.lit(expected)), F.transform("slots", lambda x: x.cast("int"))).alias("missing"))


def selection_hash(selected: DataFrame) -> DataFrame:
    """A digest of each student's selected pages."""
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "source"))), lambda x: F.concat_ws(":", x["slot"].cast("string"), x["source"].cast("string"))), ",")
    return selected.groupBy("entity").agg(F.sha2(told, 256).alias("digest"))


def stale(current: DataFrame, graded: DataFrame) -> DataFrame:
    """Grading is stale, and its score void, where the selection is no longer the graded one."""
    j = graded.select("entity", F.col("digest").alias("graded_digest"), "score").join(current, "entity", "left")
    old = ~F.coalesce(F.col("digest") == F.col("graded_digest"), F.lit(False))
    return j.select("entity", old.alias("stale"), F.when(~old, F.col("score")).alias("score"))


def reconcile(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each key as matched, missing or unexpected."""
    a, b = expected.select(F.col(key)).distinct().withColumn("e", F.lit(1)), found.select(F.col(key)).distinct().withColumn("f", F.lit(1))
    j = a.join(b, key, "full")
    return j.select(key, F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("matched").alias("status"))


def conflicts(claims: DataFrame) -> DataFrame:
    """Sources that several students claim."""
    return claims.groupBy("source").agg(F.count_distinct("entity").alias("owners")).where("owners > 1")


def gradable(selected: DataFrame, state: DataFrame, expected: int) -> DataFrame:
    """A status that allows it, slots exactly 1 to n, and every source claimed once; else a reason."""
    claims = selected.groupBy("source").agg(F.count("*").alias("claims"))
    by = selected.join(claims, "source").groupBy("entity").agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.max("claims").alias("claims"))
    j = state.join(by, "entity", "left")
    fine = F.col("status").isin("auto_matched", "approved", "verified") & (F.transform("slots", lambda x: x.cast("int")) == F.sequence(F.lit(1), F.lit(expected))) & (F.col("claims") == 1)
    return j.select("entity", F.coalesce(fine, F.lit(False)).alias("gradable"))


def unprotected(groups: DataFrame, log: DataFrame) -> DataFrame:
    """T5: groups that no human decision has touched; only these may be reassessed."""
    return groups.join(log.select("entity").distinct(), "entity", "left_anti")


def not_sent(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Queue rows without a SENT row of the same roll and address."""
    sent = log.where("status = 'SENT'").select("roll_no", F.lower("email").alias("sent_to")).distinct()
    return queue.join(sent, (queue["roll_no"] == sent["roll_no"]) & (F.lower(queue["email"]) == sent["sent_to"]), "left_anti")


def release(students: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8: the queue, and what is skipped with its first reason."""
    reason = F.when(F.col("email").isNull() | (F.col("email") == ""), "missing_email").when(~F.col("eligible"), "not_eligible").when(F.col("status").isin("needs_review", "missing_pages", "rejected"), F.concat(F.lit("status_"), F.col("status"))).when(~F.col("has_pdf"), "missing_pdf")
    told = students.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


# Fixed, ordered rules: a text found in the flags, and what it means.
REASONS = (
    ("duplicate page-", "duplicate_claim"), ("missing page", "missing_counterpart"), ("no page-1 sheet has the same roll", "no_verified_page1_anchor"),
    ("does not match the verified page-1 program", "program_mismatch"), ("produced conflicting candidates", "cell_strip_or_field_conflict"),
    ("could not be decoded confidently", "no_literal_roll"), ("low confidence", "low_identity_confidence"),
)


def rejection_reason(flags: Column, page: Column) -> Column:
    """The first rule that matches."""
    text = F.lower(flags)
    out = F.concat(F.lit("other_page_"), page.cast("string"))
    for needle, reason in reversed(REASONS):
        out = F.when(text.contains(needle), reason).otherwise(out)
    return out


#: The same with all wordings of a rule, in order; what follows them asks for selector, program and roll.
ALL_REASONS = (
    (("duplicate page-",), "duplicate_claim"), (("missing page", "missing counterpart"), "missing_counterpart"), (("no page-1 sheet has the same roll",), "no_verified_page1_anchor"),
    (("does not match the verified page-1 program",), "program_mismatch"), (("produced conflicting candidates",), "cell_strip_or_field_conflict"),
    (("could not be decoded confidently", "did not produce a valid roll"), "no_literal_roll"), (("low confidence", "requires manual confirmation"), "low_identity_confidence"),
)
TALLIED = (
    (("duplicate",), "duplicate_claim"), (("orientation marker", "could not validate"), "inspection_or_alignment_failure"), (("program selector",), None), (("conflicting candidates", "conflicts with"), "conflicting_identity"),
    (("could not be decoded", "did not produce", "unreadable"), "unreadable_roll"), (("low confidence", "whole-strip"), "low_resnet_confidence"), (("no page-1 sheet", "missing page"), "missing_counterpart"),
)


def _any_of(text: Column, needles: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*(text.contains(n) for n in needles)), True)


def page_rejection(flags: Column, page: Column, program: Column, roll: Column) -> Column:
    """Why a page was not matched: the first rule that its flags (array), program and roll meet."""
    text = F.lower(F.array_join(F.coalesce(flags, F.array().cast("array<string>")), " | "))
    blank = text.contains("continuation program selector is blank") | (~text.contains("continuation program selector is ambiguous") & text.contains("program selector is blank"))
    found = [F.when(_any_of(text, needles), reason) for needles, reason in ALL_REASONS]
    selector = F.when(blank, F.when(program.eqNullSafe("BTECH"), "blank_selector_btech").otherwise("blank_selector_postgraduate"))
    return F.coalesce(*found, selector, F.when(F.coalesce(roll, F.lit("")) == "", "no_literal_roll"), F.concat(F.lit("other_page_"), F.coalesce(F.nullif(page, F.lit(0)).cast("string"), F.lit("unknown"))))


def unmatched_reason(flags: Column, program: Column) -> Column:
    """A page's cause for the tally of a run."""
    text = F.lower(F.array_join(F.coalesce(flags, F.array().cast("array<string>")), " "))
    selector = F.when(program.eqNullSafe("BTECH"), "program_selector_btech").otherwise("program_selector_postgraduate")
    return F.coalesce(*(F.when(_any_of(text, needles), F.lit(reason) if reason else selector) for needles, reason in TALLIED), F.lit("other"))


def queue_matches(kind: str, status: Column, flags: Column, search: str, text: Column) -> Column:
    """A named queue and a search text in any case."""
    rows = {"all": F.lit(True), "review": status == "needs_review", "flagged": flags > 0, "ready": status.isin("verified", "approved")}[kind]
    return rows & F.lower(text).contains(search.lower())


def next_in_queue(queue: DataFrame) -> DataFrame:
    """Who follows each student by roll. The queue of a screen is one list by nature."""
    return queue.withColumn("next_roll", F.lead("roll_no").over(Window.partitionBy("centre").orderBy("roll_no")))


def counted(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """How often each status occurs, known ones also if never."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, known))).alias(column))
    by = rows.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(by, column, "full").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def reused(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """T4: evidence found in the cache by its content's digest, or to be made."""
    return pages.join(cache.select("digest", "evidence").dropDuplicates(["digest"]), "digest", "left").withColumn("hit", F.col("evidence").isNotNull())


def marks_label(stale_: Column, graded: Column, changed: Column, complete: Column) -> Column:
    """Stale before graded before changed before incomplete before not graded."""
    return F.when(stale_, "stale").when(graded, "graded").when(changed, "changed").when(~complete, "incomplete").otherwise("not graded")
