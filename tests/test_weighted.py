"""Labels' weights come without a join: rows stay dealt as they are."""

from pyspark.sql import functions as F

from gradeloom.operators import matching as M


def test_weights_leave_rows_where_they_are(spark):
    rows = spark.range(0, 1000, 1, 10).select("id", F.when(F.col("id") % 10 == 9, None).otherwise(F.col("id") % 3).cast("double").alias("y"))
    told = M._weighted(rows.where("id % 3 <> 2 OR id % 2 = 0"), "y")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and told.rdd.getNumPartitions() == 10
    kept = rows.where("id % 3 <> 2 OR id % 2 = 0").collect()
    many = {y: sum(r.y == y for r in kept) for y in (0.0, 1.0, 2.0)}
    assert {(r.y, round(r.weight, 9)) for r in told.collect()} == {(y, round(len(kept) / (4 * n), 9)) for y, n in many.items()}
    assert told.count() == sum(many.values())
    assert {round(r.weight, 9) for r in M._weighted(rows.where("y < 2"), "y", 2).where("y = 1").collect()} == {round(600 / (2 * 300), 9)}
