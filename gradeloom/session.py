"""Session helpers: building a session for tests and making the package visible to Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "8", app: str = "gradeloom") -> SparkSession:
    """A local session as used by the tests and by bench.py."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def expose_package(spark: SparkSession) -> None:
    """Put this package's folder on the import path of Python workers.

    A cluster installs the package (or ships it with ``--py-files``); this only spares
    local runs that start outside the repository folder.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a default only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/gradeloom-checkpoints"
    return found.rstrip("/")


def dealt(rows: DataFrame, *keys: str, each: int = 256) -> DataFrame:
    """Rows dealt to tasks of about so many: keys are few bytes beside the work that hangs on them, so no size in bytes tells how many tasks it needs."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)


class NotAvailable(RuntimeError):
    """An operator needs a library that is not installed."""


def need(module: str, what: str):
    """The module, or a clear refusal; results are never faked."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise NotAvailable(f"{what} needs {module}, which is not installed") from e
