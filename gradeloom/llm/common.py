"""What the operators share: reading tables, shared storage, Arrow helpers and word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python handles at once; Spark bounds an Arrow batch's bytes besides (64 MB by default).
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one that is set here if unset.

    A default is only taken on a local master (as in tests); a cluster has to name its folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/gradeloom-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gradeloom-{uuid.uuid4().hex}/{name}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, so that Arrow carries nothing else (and clashing extras don't matter)."""
    return df.select(*[F.col(c) for c in columns])


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def put_file(folder: str, name: str, data: bytes | pa.Buffer) -> None:
    """Written under a name of its own, then renamed: a task that runs twice leaves the same file."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")


def write_arrow(folder: str, name: str, table: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    put_file(folder, name, sink.getvalue())


def read_arrow(folder: str, name: str, columns: list[str]) -> pa.Table:
    store, path = store_of(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return pa.ipc.open_file(f.read_buffer()).read_all().select(columns)


_held: dict[str, Callable[[], object]] = {}


def alone(name: str, clear: Callable[[], object]) -> None:
    """Called when a task begins in a worker: what other operators have kept there is dropped."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    _held[name] = clear


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of plans that are done only then."""
    spark.sparkContext._jvm.System.gc()


def smaller(batches: Iterable[pa.RecordBatch], size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many, for what makes much of each row."""
    for rows in batches:
        for at in range(0, rows.num_rows, size):
            yield rows.slice(at, size)


def portions(batches: Iterable[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, and of about so many bytes in the column, of texts."""
    for some in batches:
        if not some.num_rows:
            continue
        # a batch ends where rows or bytes pass a multiple of their bound
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(some.column(column)), 0), dtype=np.int64)) // size
        at = 0
        while at < some.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1))))
            yield some.slice(at, to - at)
            at = to


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of other than space and \\x09-\\x0D: what bytes.split() does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
