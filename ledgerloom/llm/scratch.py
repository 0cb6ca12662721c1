"""Shared storage for lineage cuts: everything written here must be readable by every executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
ROWS_A_TASK = 100_000
LEAST_TASKS = 4
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session that names none (tests) gets a temporary one."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None, per_task: int = ROWS_A_TASK) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    rows: a bound on the number of rows, where it is known. Small tables are then made by few tasks (LEAST_TASKS at least) and lie
    in few files; a large one is made by as many tasks as ever.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // per_task)))
    path = new_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what is materialized inside, when it ends, but for the tables that are given to the function it yields.

    Only for steps whose result is itself materialized: nothing read later may come from what is removed. What is kept
    belongs to the scope around, if there is one.
    """
    paths: list[str] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._scratch_path)
        return table

    _scopes.append(paths)
    try:
        yield keep
    finally:
        _scopes.pop()
        for path in paths:
            if path not in kept:
                remove(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, on whichever file system the shared folder is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
