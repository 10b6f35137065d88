"""Incremental operators on streams (T1, T3, T7, K10, X4), each run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gradeloom import schemas
from gradeloom.session import shared_dir


def _home(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gradeloom-stream-{uuid.uuid4().hex}/{name}"


def files_stream(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """New Parquet files of a folder, or those that a name matches, as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()


def decision_stream(spark: SparkSession, path: str) -> DataFrame:
    """An append-only decision log as a stream of new files."""
    e = files_stream(spark, schemas.EVENTS, path)
    action = F.when(F.col("event_type") == "click", "verify").when(F.col("event_type") == "view", "hold").when(F.col("event_type") == "purchase", "assign_source").when(F.col("event_type") == "signup", "approve").otherwise("reject")
    return e.select(F.col("user_id").alias("entity"), action.alias("action"), "ts", F.col("event_id").alias("seq"))


def fold_stream(log: DataFrame) -> DataFrame:
    """The latest decision of each entity (T1's commands: ``operators.commands``), kept as aggregation state; each trigger's changes are a batch of their own.

    A batch that is run again replaces itself. The table is each entity's row of the last batch that changed it.
    """
    spark = log.sparkSession
    out, marks = _home(spark, "state"), _home(spark, "checkpoint")
    last = F.max(F.struct("ts", "seq", "action")).alias("last")
    state = log.groupBy("entity").agg(last, F.count("*").alias("decisions")).select("entity", F.col("last.action").alias("action"), F.col("last.seq").alias("seq"), "decisions")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    state.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    newest = F.max_by(F.struct("action", "seq", "decisions"), "batch").alias("s")
    return spark.read.parquet(out).groupBy("entity").agg(newest).select("entity", "s.*")


def inspect_stream(spark: SparkSession, path: str, schema: str, done: DataFrame, key: str) -> DataFrame:
    """New rows that are not done yet; a restart goes on from the checkpoint."""
    out, marks = _home(spark, "inspected"), _home(spark, "checkpoint")

    def put(batch: DataFrame, number: int) -> None:
        batch.join(done, key, "left_anti").write.mode("overwrite").parquet(f"{out}/batch={number}")

    files_stream(spark, schema, path).writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def send_once(queue: DataFrame, keys: list[str], log: str | None = None, put_again: bool = False) -> DataFrame:
    """Rows of a queue that the log at the given path (else a new one) has not yet, each sent once.

    A batch is written under its number, without what other batches have sent; so one that comes again after a
    failure replaces itself by the same rows. put_again has each batch come twice, for tests.
    """
    spark = queue.sparkSession
    log = log or _home(spark, "sent")
    marks = f"{log}-checkpoint"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queue.schema.fields if f.name in keys)
    spark.createDataFrame([], f"{kinds}, status string").write.mode("ignore").parquet(f"{log}/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        for _ in range(2 if put_again else 1):
            others = batch.sparkSession.read.parquet(log).where(F.col("batch") != number).select(*keys)
            fresh = batch.select(*keys).dropDuplicates(keys).join(others, keys, "left_anti")
            fresh.withColumn("status", F.lit("SENT")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    queue.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(log).drop("batch")


class Progress(StreamingQueryListener):
    """Rows read, told to a callback after each trigger."""

    def __init__(self, tell) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"state": "started"})

    def onQueryProgress(self, event) -> None:
        self.tell({"state": "running", "rows": event.progress.numInputRows})

    def onQueryTerminated(self, event) -> None:
        self.tell({"state": "done"})
