"""Writers: tables that are replaced as a whole, and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators.projection import graph_export


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces a table. df must not read from path: write to a staging path first if it does."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def export_graph(nodes: DataFrame, edges: DataFrame, facts: DataFrame, path: str) -> None:
    """nodes and edges (facts as REPORTS edges among them) as JSON lines, sorted within files by id."""
    nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(f"{path}/nodes")
    graph_export(edges, facts).repartitionByRange("subject_id").sortWithinPartitions("subject_id", "predicate", "object_id", "period").write.mode("overwrite").json(f"{path}/edges")


def publish_checked(df: DataFrame, staging: str, path: str, problems: Callable[[DataFrame], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to staging, and to path only if `problems` finds none in what was staged; returns the problems.

    A target that fails so leaves the published table as it was.
    """
    publish(df, staging, partition_by)
    staged = df.sparkSession.read.schema(df.schema).parquet(staging)
    found = problems(staged)
    if found.isEmpty():
        publish(staged, path, partition_by)
    return found


def is_fresh(spark: SparkSession, path: str, days: int) -> bool:
    """Whether a landed file is younger than so many days, so that it need not be fetched again."""
    files = spark.read.format("binaryFile").load(path).select("modificationTime")
    return not files.filter(F.col("modificationTime") > F.current_timestamp() - F.make_dt_interval(days=F.lit(days))).isEmpty()


def sync_master(master: DataFrame, path: str) -> int:
    """Replaces the landed company register and returns its number of rows."""
    publish(master, path)
    return master.sparkSession.read.parquet(path).count()
