"""Rows that much work hangs on are dealt to tasks by number, though they are few bytes."""

from pyspark.sql import functions as F

from gradeloom.plans import q_more, q_scans
from gradeloom.session import dealt


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_few_bytes_go_to_many_tasks(spark):
    rows = spark.range(1000)
    assert tasks(rows.repartition("id")) == 1
    assert tasks(dealt(rows, "id", each=100)) == 10
    assert dealt(rows.limit(0), "id").count() == 0


def test_drawn_scans_are_dealt(spark, tmp_path):
    rows = spark.range(2100).select(F.col("id").alias("s_suppkey"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert tasks(q_more.drawn(spark, str(tmp_path))) == 3
    assert q_scans.photos(spark, str(tmp_path)).rdd.getNumPartitions() == 9
