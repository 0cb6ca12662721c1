"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    chat, decontaminate, digest_index, filter_audit, mixing, multi_index, near_dedup, records, run_length_index, structure_repair, substring_dedup,
    toxicity, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.dedup(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_maximal(_table(spark, sf_dir, "conversations"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = records.encode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.train(url_filter.labelled(spark)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return structure_repair.repair(structure_repair.damage(conversations), conversations)


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.dedup(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(filter_audit.cells(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def queries() -> dict:
    found = (
        op1_multi_index, op2_toxicity, op3_mixing, op4_run_length_index, op5_chat_format,
        op6_binary_records, op7_url_filter, op8_decontaminate, op9_substring_dedup, op10_near_dedup,
        op11_structure_repair, op12_digest_index, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_format": chat.oracle_sql(), "op7_url_filter": url_filter.oracle_sql(), "op12_digest_index": digest_index.oracle_sql(),
        "op13_filter_audit": filter_audit.oracle_sql(),
    }
