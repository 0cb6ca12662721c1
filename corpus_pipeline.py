"""A training-data pipeline over documents: five operators, each on all that its predecessor kept.

Defined results: an empty table gives no rows; null and empty texts score by the bias alone, are copies of each other by
the rules of near_dedup, hold no benchmark passage, have size 0 and so leave in mixing; rows with a null doc_id are documents
like others; extra columns stay as they are until the last stage. Without labels no document is toxic.

Each stage has the session send rows to Python in batches of BATCH_ROWS at most, and leaves it so: the operators work through no
more at once, and a batch of Spark's usual ten thousand texts is held by the executor and its Python worker alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, near_dedup, records, scratch, toxicity
from ledgerloom.llm.queries import tokenizer_path


BATCH_ROWS = 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_short_batches(stage: Callable) -> Callable:
    @wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_SETTING)) <= BATCH_ROWS:
            spark.conf.set(_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return staged


@in_short_batches
def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled documents that are not held out; documents that score the threshold or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@in_short_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the least id stays."""
    return near_dedup.keep_one(docs)


@in_short_batches
def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_short_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.apply(docs)


@in_short_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary records: doc_id, start, n_tokens, ids_crc32, shard, offset, length of each."""
    return records.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_dedup", one_of_each_group),
    ("decontamination", contaminated_documents_go),
    ("mixing", mixed),
    ("token_records", encoded),
]

#: SQL can't express these stages; tests/llm compares each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch.scope(spark) as keep:
            docs = keep(scratch.materialize(stage(spark, before, sf_dir), f"stage-{name}"))
        if name != STAGES[0][0]:
            scratch.remove(spark, before._scratch_path)
    return STAGES[-1][1](spark, docs, sf_dir)
