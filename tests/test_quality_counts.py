"""Text quality looks at each text once and counts as its regular expressions do."""

import random

from pyspark.sql import functions as F

from gradeloom.functions import scalars as P


def by_expressions(text):
    """The same by Spark's regular expressions, one for each count."""
    t = F.regexp_replace(text, r"\s+", "")
    n = F.greatest(F.length(t), F.lit(1))
    plain = F.length(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))
    runs = F.regexp_count(text, F.lit(r"[_=\-]{3,}|[^\w\s]{4,}"))
    score = 0.20 + 0.48 * (plain / n) + 0.22 * F.least(F.lit(1.0), F.length(t) / 14.0) - 0.35 * ((F.length(t) - plain) / n) - F.least(F.lit(0.30), 0.12 * runs)
    return F.when(F.length(t) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def test_counts_equal_expressions(spark):
    random.seed(9)
    pieces = ["a", "Z9", " ", "\n", "\x0b", "\t\r", "=", "--", "___", "!!", "é", "漢字", "😀", " ", "​", "…", "٣", "_a"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 40))) for _ in range(600)] + [None, "", "   ", "====!!!!", "!===", "==!!!!", "x" * 5000 + "....."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    told = df.select("text", P.text_quality(F.col("text")).alias("a"), by_expressions(F.col("text")).alias("b")).collect()
    assert len(told) == len(texts) and all(r.a == r.b for r in told)
    assert df.where("text IS NULL").select(P.text_quality(F.col("text")).alias("a")).first().a == 1.0
    assert df.where("i < 0").select(P.text_quality(F.col("text")).alias("a")).count() == 0


def test_a_text_is_looked_at_once(spark):
    plan = spark.range(1).select(P.text_quality(F.col("id").cast("string")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
