"""Extensions: quality of extractions against a ground truth, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def match_quality(truth: DataFrame, found: DataFrame, key: str, share: str) -> DataFrame:
    """One row: matched, truth_n, found_n, recall, precision (null if there is nothing to divide by), share_mae."""
    t = truth.select(F.lower(key).alias("k"), F.col(share).alias("t"))
    f = found.select(F.lower(key).alias("k"), F.col(share).alias("f"))
    both = t.withColumn("in_t", F.lit(1)).join(f.withColumn("in_f", F.lit(1)), "k", "full_outer")
    counts = both.agg(
        F.count(F.expr("CASE WHEN in_t = 1 AND in_f = 1 THEN 1 END")).alias("matched"), F.count("in_t").alias("truth_n"),
        F.count("in_f").alias("found_n"), F.round(F.avg(F.abs(F.col("t") - F.col("f"))), 6).alias("share_mae")
    )
    div = lambda n: F.round(F.try_divide(F.col("matched").cast("double"), F.col(n).cast("double")), 6)
    return counts.withColumns({"recall": div("truth_n"), "precision": div("found_n")})


def run_summary(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and sample deviation (null for a single run) of a value."""
    return runs.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev"))
