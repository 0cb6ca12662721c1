"""A ledger of landed files: only those that are new or changed are read again. And fingerprints, which prove tables equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

LEDGER = "path string, length long, modificationTime timestamp"
_STATE = ("path", "length", "modificationTime")


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of all files under a path, from the listing alone: no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(*_STATE)


def changed_files(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """The files that the ledger doesn't hold as they are now."""
    return landed_files(spark, path).join(ledger.select(*_STATE), list(_STATE), "left_anti")


def read_changed(spark: SparkSession, path: str, ledger: DataFrame, read: Callable[[list[str]], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the new and changed files, None if there are none; the ledger after them).

    The files are settled once, here, so that what is read is what goes on record; a file that changes meanwhile differs
    from its record and is read the next time. Spark's scan keeps the names of its files on the driver anyway.
    """
    found = changed_files(spark, path, ledger).collect()
    if not found:
        return None, ledger
    fresh = spark.createDataFrame(found, LEDGER)
    after = ledger.select(*_STATE).join(fresh.select("path"), "path", "left_anti").unionByName(fresh)
    return read([r["path"] for r in found]), after


def _hashed(df: DataFrame, seed: int) -> Column:
    """A hash of a row's values; maps count by their sorted entries."""
    cols = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in sorted(df.schema.fields, key=lambda f: f.name)]
    # Nulls don't change Spark's hash of a row, so a row's pattern of nulls is hashed with it.
    return F.xxhash64(F.lit(seed), *cols, *(c.isNull() for c in cols))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n, sum_1, sum_2: sums of two hashes of the rows. Equal rows give equal sums in any order and partitioning, repeats counted.

    Columns are taken by name; nested maps can't be hashed. Partial sums leave each task, no row does.
    """
    wide = lambda seed: F.coalesce(F.sum(_hashed(df, seed).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n"), wide(1).alias("sum_1"), wide(2).alias("sum_2"))


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows under the same column names and types."""
    kinds = lambda df: sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return kinds(a) == kinds(b) and fingerprint(a).unionByName(fingerprint(b)).distinct().count() == 1
