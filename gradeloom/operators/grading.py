"""Grading: objective and written answers, totals and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade_mcq(responses: DataFrame, key: DataFrame) -> DataFrame:
    """Each response against its key. Marks of 0 drop a question: no marks, no flag, not in the total.

    The key is a small dimension; Spark broadcasts it by its size.
    """
    joined = responses.join(key.select("q_no", "answer", "marks"), "q_no", "left")
    missing, dropped = F.col("marks").isNull(), F.coalesce(F.col("marks") == 0, F.lit(False))
    right = (F.col("outcome") == "answered") & (F.col("selected") == F.col("answer"))
    return joined.select(
        *responses.columns,
        "answer",
        F.when(missing | dropped, 0.0).otherwise(F.col("marks")).alias("marks"),
        F.when(~missing & ~dropped & F.coalesce(right, F.lit(False)), F.col("marks")).otherwise(0.0).alias("awarded"),
        dropped.alias("dropped"),
        missing.alias("no_key"),
        (~dropped & ((F.col("confidence") != "high") | missing)).alias("review"),
    )


def totals(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Score and total of each sheet, flags, and whether it is ready."""
    return graded.groupBy(*keys).agg(
        F.sum("awarded").alias("score"), F.sum("marks").alias("total"), F.count_if("review").alias("review_flags"), F.count_if("dropped").alias("dropped"),
    ).withColumn("status", F.when(F.col("review_flags") > 0, "needs_review").otherwise("ready"))


def key_values(answer: Column) -> Column:
    """The distinct whole numbers of an answer with alternatives, ascending."""
    parts = F.filter(F.transform(F.split(answer, r"[|,]"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x.rlike(r"^\d+$"))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.cast("int"))))


def grade_numerical(responses: DataFrame, key: DataFrame) -> DataFrame:
    """Right if the value is one of the alternatives; null if the question is unresolved."""
    joined = responses.join(key.select("q_no", "answer", F.col("marks").alias("key_marks")), "q_no", "left")
    values = key_values(F.col("answer"))
    dropped = F.coalesce(F.col("key_marks") == 0, F.lit(False))
    right = F.array_contains(values, F.col("value"))
    awarded = F.when(dropped, 0.0).when(F.col("key_marks").isNull(), None).when(F.col("value").isNotNull() & right, F.col("key_marks")).otherwise(0.0)
    return joined.select(*responses.columns, F.when(dropped, 0.0).otherwise(F.col("key_marks")).alias("marks"), awarded.alias("awarded"), dropped.alias("dropped"))


def strict_total(graded: DataFrame, keys: list[str]) -> DataFrame:
    """A3 as the review screen has it: null as soon as one part is null."""
    whole = F.bool_and(F.col("awarded").isNotNull())
    return graded.groupBy(*keys).agg(F.when(whole, F.sum("awarded")).alias("score"), F.when(whole, F.sum("marks")).alias("total"))


def lenient_total(graded: DataFrame, keys: list[str]) -> DataFrame:
    """A3 as the release has it: nulls count as absent."""
    return graded.groupBy(*keys).agg(F.sum("awarded").alias("score"), F.sum(F.when(F.col("awarded").isNotNull(), F.col("marks"))).alias("total"))


def legacy_grade(responses: DataFrame, key: DataFrame) -> DataFrame:
    """The older scoring has no dropped questions; zero marks still flag review."""
    joined = responses.join(key.select("q_no", "answer", "marks"), "q_no", "left")
    right = F.coalesce((F.col("outcome") == "answered") & (F.col("selected") == F.col("answer")), F.lit(False))
    return joined.select(*responses.columns, F.coalesce("marks", F.lit(0.0)).alias("marks"), F.when(right, F.col("marks")).otherwise(0.0).alias("awarded"), ((F.col("confidence") != "high") | F.col("marks").isNull()).alias("review"))


def validate_written(grades: DataFrame) -> DataFrame:
    """Errors of a written grade, and whether a person has to look."""
    error = F.when(F.abs(F.col("max_marks") - F.col("request_max")) > 0.001, "max_mismatch").when((F.col("marks") < 0) | (F.col("marks") > F.col("request_max")), "out_of_range")
    review = F.col("marks").isNull() | (F.col("confidence") == "low") | (F.coalesce("justification", F.lit("")) == "")
    return grades.withColumn("error", error).withColumn("needs_review", review)


def apply_marks(packet: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """A packet with its marks, the last row of each key counting; blank stays pending, a flag asks for review."""
    last = Window.partitionBy(*keys).orderBy(F.desc("row_no"))
    one = marks.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "row_no")
    joined = packet.join(one, keys, "left")
    status = F.when(F.col("marks").isNull(), "pending").when((F.col("marks") < 0) | (F.col("marks") > F.col("max_marks")), "error").when(F.coalesce("flag", F.lit(False)), "needs_review").otherwise("graded")
    return joined.withColumn("status", status)


def final_scores(written: DataFrame, objective: DataFrame, key: str) -> DataFrame:
    """A5: pending before needs_review before complete; the total only if complete and the objective score is known."""
    w = written.groupBy(key).agg(
        F.sum(F.when(F.col("status") == "graded", F.col("marks"))).alias("written_score"), F.sum("max_marks").alias("written_total"),
        F.when(F.bool_or(F.col("status") == "pending"), "pending").when(F.bool_or(F.col("status") != "graded"), "needs_review").otherwise("complete").alias("status"),
    )
    joined = w.join(objective.select(key, F.col("score").alias("objective_score")), key, "left")
    return joined.withColumn("total_score", F.when((F.col("status") == "complete") & F.col("objective_score").isNotNull(), F.col("written_score") + F.col("objective_score")))


def combine_markers(marks: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Complete if all required markers gave one mark; disagreement if they differ; else awaiting_marks."""
    given = marks.groupBy(*keys).agg(F.collect_set("marker").alias("given"), F.count_distinct("marks").alias("values"), F.min("marks").alias("mark"))
    joined = required.groupBy(*keys).agg(F.collect_set("marker").alias("required")).join(given, keys, "left")
    lacking = F.size(F.array_except("required", F.coalesce("given", F.expr("cast(array() as array<string>)"))))
    status = F.when(lacking > 0, "awaiting_marks").when(F.col("values") == 1, "complete").otherwise("disagreement")
    return joined.select(*keys, status.alias("status"), F.when(status == "complete", F.col("mark")).alias("mark"))


def mock_grade(max_marks: Column, fraction: float = 0.5) -> Column:
    """The stand-in grader's mark, in four places."""
    return F.round(max_marks * fraction, 4)
