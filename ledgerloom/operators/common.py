"""Small relational building blocks shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, keys: list, order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key, in an order that should be total."""
    return ranked(df, keys, order, "_rn").filter("_rn = 1").drop("_rn")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dealt(df: DataFrame) -> DataFrame:
    """df's rows in turn over as many tasks as a shuffle has, and no fewer than two a core; for rows that are small and costly."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that executors share (spark.checkpoint.dir) and read back: a base that several branches read.

    Only a local session that names no folder (tests) gets a temporary one.
    """
    spark = df.sparkSession
    setting = "spark.checkpoint.dir"
    folder = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {setting} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set(setting, folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
