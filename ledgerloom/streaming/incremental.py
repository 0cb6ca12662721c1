"""Incremental ingest as a stream of landed listings, with exactly the new reports handed on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.sources.landing import LISTED


def listing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines of filings as a stream."""
    return spark.readStream.schema(LISTED).json(path)


ATTEMPTS = 3
FAILED = f"{LISTED}, error string, attempts int, batch_id long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What batches have written under a path; nothing before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def guarded(reports: DataFrame, run: Callable[[dict], dict], result: str) -> DataFrame:
    """A row for each report: rcept_no, what run(report as a dict) gives as a struct `done`, or the error that it raised."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({"rcept_no": row["rcept_no"], "done": run(row), "error": None})
                except Exception as problem:  # noqa: BLE001  one report's fault is a row, not the batch's end
                    out.append({"rcept_no": row["rcept_no"], "done": None, "error": f"{type(problem).__name__}: {problem}"})
            yield pa.RecordBatch.from_pylist(out, kind)

    schema = f"rcept_no string, done struct<{result}>, error string"
    kind = to_arrow_schema(reports.sparkSession.createDataFrame([], schema).schema)
    return reports.mapInArrow(each, schema)


def take(
    batch: DataFrame, batch_id: int, universe: DataFrame, known_path: str, prefix: str, handle: Callable[[DataFrame, int], DataFrame | None],
    failures_path: str | None = None, attempts: int = ATTEMPTS
) -> None:
    """One batch of listings: the new reports of the universe and those that failed before, fewer than `attempts` times, go to `handle`.

    handle returns rcept_no, error of the reports that failed, or None. These are put aside with their attempts counted, the
    others are on record. Both are written under the batch's id, so a batch that runs again replaces what it wrote.
    """
    spark = batch.sparkSession
    known = _stored(spark, known_path, "rcept_no string, batch_id long").filter(F.col("batch_id") != batch_id)
    wanted = batch.filter(F.col("report_nm").startswith(prefix)).join(universe, "corp_code", "left_semi").withColumn("attempts", F.lit(0))
    if failures_path:
        before = _stored(spark, failures_path, FAILED).filter(F.col("batch_id") != batch_id)
        last = before.groupBy("rcept_no").agg(F.max_by(F.struct(*before.columns), "attempts").alias("f")).select("f.*").drop("error", "batch_id")
        # A report that is listed again goes on with its count; one that has failed too often stays where it is.
        wanted = wanted.join(last.select("rcept_no"), "rcept_no", "left_anti").unionByName(last.filter(F.col("attempts") < attempts))
    fresh = wanted.join(known.select("rcept_no"), "rcept_no", "left_anti").dropDuplicates(["rcept_no"]).persist()
    try:
        failed = handle(fresh.drop("attempts"), batch_id)
        done = fresh.select("rcept_no")
        if failed is not None:
            if not failures_path:
                raise ValueError("failures need a path")
            failed = failed.groupBy("rcept_no").agg(F.min("error").alias("error"))
            aside = fresh.join(failed, "rcept_no").withColumn("attempts", F.col("attempts") + 1)
            aside.select(*(c.split()[0] for c in f"{LISTED}, error, attempts".split(", "))).write.mode("overwrite").parquet(f"{failures_path}/batch_id={batch_id}")
            # What has failed is read back: handle is not asked twice.
            done = done.join(_stored(spark, failures_path, FAILED).filter(F.col("batch_id") == batch_id).select("rcept_no"), "rcept_no", "left_anti")
        done.write.mode("overwrite").parquet(f"{known_path}/batch_id={batch_id}")
    finally:
        fresh.unpersist()


def run_incremental(
    stream: DataFrame, universe: DataFrame, known_path: str, prefix: str, handle: Callable[[DataFrame, int], DataFrame | None], checkpoint: str,
    failures_path: str | None = None, attempts: int = ATTEMPTS
):
    """Takes all that has landed, batch by batch (see take), and stops."""
    each = lambda batch, batch_id: take(batch, batch_id, universe, known_path, prefix, handle, failures_path, attempts)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_failed(
    spark: SparkSession, universe: DataFrame, known_path: str, prefix: str, handle: Callable[[DataFrame, int], DataFrame | None], failures_path: str,
    attempts: int = ATTEMPTS
) -> None:
    """Hands on the failed reports again where nothing new has landed. Its batches count down from -1, beside the stream's own."""
    least = _stored(spark, failures_path, FAILED).agg(F.min("batch_id")).first()[0]
    take(spark.createDataFrame([], LISTED), min(least or 0, 0) - 1, universe, known_path, prefix, handle, failures_path, attempts)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", at: str = "ts", key: str = "event_type") -> DataFrame:
    """Extension: tumbling counts and sums with a watermark; works on streams and on tables."""
    grouped = events.withWatermark(at, late) if events.isStreaming else events
    return grouped.groupBy(F.window(at, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
