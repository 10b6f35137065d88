"""Reassessing saved ownership without touching human decisions, and approving clean matches all or none (T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICY = "exact-ownership-v1-2026-10-03"
UNCERTAIN = "Missing or uncertain page ownership; inspect Suggested and Unmatched pages."
LEGACY = "Legacy grading evidence must be reviewed before approval."


def selected(held: DataFrame) -> DataFrame:
    """roll, slot, source: of the pages a student holds in a slot the one put there by hand, else the later one.

    held: roll, source, slot, manual.
    """
    last = Window.partitionBy("roll", "slot").orderBy(F.desc("manual"), F.desc("source"))
    return held.where("slot IS NOT NULL").withColumn("place", F.row_number().over(last)).where("place = 1").select("roll", "slot", "source")


def protected_rolls(students: DataFrame, held: DataFrame) -> DataFrame:
    """roll: students that a human decided on, by log, by hand-placed pages or by status."""
    told = students.where("decided OR status IN ('verified', 'approved', 'rejected')").select("roll")
    return told.unionByName(students.join(held.where("manual").select("roll"), "roll", "left_semi").select("roll")).distinct()


def protected_sources(kept: DataFrame, held: DataFrame, unmatched: DataFrame) -> DataFrame:
    """source: selected pages of protected students, and unmatched ones that were decided on or ignored."""
    own = selected(held).join(kept, "roll", "left_semi").select("source")
    return own.unionByName(unmatched.where("decided OR status = 'ignored'").select("source")).distinct()


def reassess(students: DataFrame, held: DataFrame, unmatched: DataFrame, owned: DataFrame, groups: DataFrame, ledger: DataFrame, grouping_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T5: students, held and unmatched pages after the saved evidence was assessed anew.

    A group of the assessment applies if neither its roll nor any of its sources is protected; a roll that has
    no student yet gets one. Unprotected students hold their group's pages, or none; protected ones and
    their pages stay as they are. An applied page without an image is an error, and nothing changes.

    students: roll, status, decided, answer_flags (array, null for legacy results), flags (array). held: roll, source,
    slot, manual. unmatched: source, status, decided, owner. owned: source_index, sheet_page, flags (J2). groups: roll, sources,
    status (A2). ledger: source, has_image.
    """
    kept = protected_rolls(students, held)
    untouchable = protected_sources(kept, held, unmatched)
    each = groups.join(kept, "roll", "left_anti").select("roll", F.col("status").alias("group_status"), F.explode("sources").alias("source"))
    touched = each.join(untouchable, "source", "left_semi").select("roll").distinct()
    applied = each.join(touched, "roll", "left_anti").join(ledger, "source", "left")
    sound = F.when(F.coalesce("has_image", F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("canonical pages are missing for "), F.col("roll"))))
    applied = applied.where(sound).drop("has_image")
    by_roll = groups.join(applied.select("roll").distinct(), "roll", "left_semi").select("roll", F.col("status").alias("group_status"), F.col("sources").alias("own"))

    new = by_roll.join(students, "roll", "left_anti").select("roll", F.lit("needs_review").alias("status"), F.lit(False).alias("decided"), F.lit(None).cast("array<string>").alias("answer_flags"), F.array().cast("array<string>").alias("flags"))
    told = students.select("roll", "status", "decided", "answer_flags", "flags").unionByName(new).join(by_roll, "roll", "left").join(kept.withColumn("protected", F.lit(True)), "roll", "left")
    none = F.array().cast("array<string>")
    base = none if grouping_only else F.coalesce("answer_flags", F.array(F.lit(LEGACY)))
    clean = (F.coalesce("group_status", F.lit("")) == "auto_matched") & (F.size(base) == 0)
    is_kept = F.coalesce("protected", F.lit(False))
    after = told.select(
        "roll", "decided", "answer_flags", is_kept.alias("protected"),
        F.when(is_kept, F.col("status")).when(clean, "auto_matched").otherwise("needs_review").alias("status"),
        F.when(is_kept, F.col("flags")).when(clean, base).otherwise(F.concat(base, F.array(F.lit(UNCERTAIN)))).alias("flags"),
        # what the decision rests on: it is asked for again when the match is approved
        F.when(~is_kept, F.struct(F.lit(POLICY).alias("policy"), F.coalesce("group_status", F.lit("needs_review")).alias("status"), F.coalesce("own", F.array().cast("array<bigint>")).alias("sources"))).alias("certificate"),
    )

    slots = owned.select(F.col("source_index").alias("source"), F.col("sheet_page").alias("slot"), F.transform(F.filter("flags", lambda f: f["severity"] == "block"), lambda f: f["code"]).alias("why"))
    pages = applied.join(slots, "source").select("roll", "source", "slot", F.lit(False).alias("manual"))
    held_after = held.select("roll", "source", "slot", "manual").join(kept, "roll", "left_semi").unionByName(pages)

    owner = applied.select("source", F.col("roll").alias("owner"))
    free = slots.join(untouchable, "source", "left_anti").join(owner, "source", "left")
    fresh = free.select("source", F.when(F.col("owner").isNotNull(), "assigned").otherwise("needs_review").alias("status"), "owner", F.when(F.col("owner").isNotNull(), F.col("slot")).alias("slot"), "why")
    others = unmatched.join(fresh, "source", "left_anti").select("source", "status", "owner", F.lit(None).cast("int").alias("slot"), F.array().cast("array<string>").alias("why"))
    return after, held_after, fresh.unionByName(others)


def unproved(students: DataFrame, held: DataFrame, groups: DataFrame, expected: int) -> DataFrame:
    """roll, why: students with status auto_matched whose ownership no longer proves itself, each with its first reason."""
    chosen = selected(held)
    claims = chosen.groupBy("source").agg(F.count("*").alias("claims"))
    by = chosen.join(claims, "source").groupBy("roll").agg(F.array_sort(F.collect_list(F.struct("slot", "source"))).alias("pages"), F.max("claims").alias("claims"))
    hands = held.where("manual").select("roll", F.lit(True).alias("by_hand")).distinct()
    j = students.where("status = 'auto_matched'").join(by, "roll", "left").join(groups.select("roll", F.col("status").alias("group_status"), F.col("sources").alias("group_sources")), "roll", "left").join(hands, "roll", "left")
    sources = F.coalesce(F.transform("pages", lambda p: p["source"]), F.array().cast("array<bigint>"))
    slots = F.coalesce(F.transform("pages", lambda p: p["slot"].cast("int")), F.array().cast("array<int>"))
    cert = F.col("certificate")
    rules = [
        ("group", F.col("group_status").eqNullSafe("auto_matched") & sources.eqNullSafe(F.col("group_sources"))),
        ("certificate", cert["sources"].eqNullSafe(sources) & cert["policy"].eqNullSafe(F.lit(POLICY)) & cert["status"].eqNullSafe(F.lit("auto_matched"))),
        ("by_hand", F.col("by_hand").isNull()),
        ("flags", F.coalesce(F.size("flags"), F.lit(0)) == 0),
        ("claims", F.col("claims").eqNullSafe(F.lit(1))),
        ("pages", slots == F.sequence(F.lit(1), F.lit(expected))),
    ]
    why = F.coalesce(*(F.when(~fine, F.lit(name)) for name, fine in rules))
    return j.select("roll", why.alias("why")).where("why IS NOT NULL")


def approve(students: DataFrame, held: DataFrame, groups: DataFrame, expected: int, confirm_count: int) -> DataFrame:
    """T5: students with all clean matches approved; an error, and none is, if their number is not the one
    confirmed or if one of them does not prove itself."""
    clean = students.where("status = 'auto_matched'").count()
    if not clean or clean != confirm_count:
        raise ValueError(f"{clean} clean matches, {confirm_count} confirmed; refresh and confirm the current count")
    bad = unproved(students, held, groups, expected).orderBy("roll").limit(1).collect()
    if bad:
        raise ValueError(f"ownership or selection changed for {bad[0].roll} ({bad[0].why}); reassess before approval")
    return students.withColumn("decided", F.col("decided") | (F.col("status") == "auto_matched")).withColumn("status", F.when(F.col("status") == "auto_matched", "approved").otherwise(F.col("status")))


def commit(rows: DataFrame, home: str) -> int:
    """A version of a table, there for readers only when all of it is written: its number is noted last.

    Only folders and appended files are used, so it holds on any file system that Spark writes to.
    """
    spark = rows.sparkSession
    last = _version(spark, home)
    rows.write.mode("overwrite").parquet(f"{home}/version={last + 1}")
    spark.createDataFrame([(last + 1,)], "number long").coalesce(1).write.mode("append").parquet(f"{home}/versions")
    return last + 1


def _version(spark: SparkSession, home: str) -> int:
    spark.createDataFrame([], "number long").write.mode("ignore").parquet(f"{home}/versions")
    return spark.read.schema("number long").parquet(f"{home}/versions").agg(F.max("number")).first()[0] or 0


def committed(spark: SparkSession, home: str) -> DataFrame | None:
    """The last version, None before the first."""
    last = _version(spark, home)
    return spark.read.parquet(f"{home}/version={last}") if last else None
