"""Exact dedup by a persistent index of text digests, bucketed and sorted by digest.

Texts are equal when they are identical after A-Z are lower-cased; their SHA-256 stands for them. The index holds one entry
for each text that was ever taken in. A new batch is combined to one row a digest, anti-joined with the index by a
sort-merge join and what remains is appended. The index is read by its buckets and never shuffled; only digests move.

What is in the index stays: a later batch can't displace it. In one batch the row with the largest id stays. So if batches
come in falling order of ids, as dedup() brings them, the largest id of the whole table stays.

Layout under the index's path: entries/ (Parquet, a partition a batch, each of `buckets` sorted files), meta/ (the number of
buckets). Taking in a batch again replaces its partition, so a batch that broke off is simply taken in once more.

Defined results: a null text counts as empty; a null id is smaller than all others and a row like any other; of rows that
share id and text exactly one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm.repeats import salted_join
from ledgerloom.llm.scratch import materialize, new_path, remove, scope

ROWS_A_BUCKET = 1_000_000
LEAST_BUCKETS = 32


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (names the row, once the table is written) and digest."""
    digest = F.unhex(F.sha2(F.encode(normalised(F.col(text_col)), "utf-8"), 256))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"))


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class DigestIndex:
    """An index at a path that all executors share. Opening one that exists takes its number of buckets from it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), f"digest_index_{uuid.uuid4().hex}"
        exists = buckets is None
        if exists:
            buckets = spark.read.schema("buckets int").json(f"{self.path}/meta").first().buckets
        else:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}/meta")
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch INT) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/entries'"
        )
        if exists:
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def entries(self) -> DataFrame:
        """digest, keep_id, keep_row, batch: one row for each text."""
        return self.spark.table(self.name)

    def new_entries(self, rows: DataFrame, batch: int) -> DataFrame:
        """What a batch adds. rows: as from digests(). Copies are combined before any shuffle, so that none of them is hot."""
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"))
        known = self.entries().filter(F.col("batch") != batch)
        fresh = groups.join(known.hint("merge"), "digest", "left_anti")
        return fresh.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.lit(batch).alias("batch"))

    def ingest(self, rows: DataFrame, batch: int) -> None:
        """Appends the texts of a batch that the index lacks: a file a bucket, sorted."""
        # Groups as many partitions as the index has buckets: one exchange serves the combining, the join and the write.
        # Only the batch's own partition is replaced, once all its files are written.
        with _settings(self.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            self.new_entries(rows, batch).repartition(self.buckets, "digest").write.mode("overwrite").insertInto(self.name)

    def judge(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size (among these rows), kept, text_sha256 of each row whose text is in the index.

        rows: as from digests(), written, with the batch in which each was taken in.
        """
        sizes = rows.groupBy("digest").agg(F.count("*").alias("c"))
        found = sizes.join(self.entries().withColumnRenamed("batch", "keep_batch").hint("merge"), "digest").withColumn("group_size", F.col("c"))
        judged = salted_join(rows, materialize(found, "groups"), ["digest"], ["row"])
        stays = (F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))
        return judged.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def close(self) -> None:
        """Takes the name out of the session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket holds about ROWS_A_BUCKET entries at most."""
    return max(LEAST_BUCKETS, 1 << (max(1, rows) // ROWS_A_BUCKET).bit_length())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. The table is taken in by falling ids, in batches of about equal size.

    path: where the index is to stay; without it the index goes once the result is written.
    """
    spark = docs.sparkSession
    with scope(spark) as keep:
        rows = materialize(digests(docs, id_col, text_col), "digests")
        cuts = rows.approxQuantile("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 0.01) if batches > 1 else []
        batch = F.lit(batches - 1)
        for i, cut in reversed(list(enumerate(cuts))):
            batch = F.when(F.col("doc_id") >= F.lit(int(cut)), F.lit(i)).otherwise(batch)
        rows = rows.withColumn("batch", batch)
        at = path or new_path(spark, "digest-index")
        index = DigestIndex(spark, at, buckets_for(rows.count()))
        try:
            for i in range(batches):
                index.ingest(rows.filter(F.col("batch") == i), i)
            out = keep(materialize(index.judge(rows), "judged"))
        finally:
            index.close()
    if path is None:
        remove(spark, at)
    return out


def oracle_sql(table: str = "documents") -> str:
    """The same in DuckDB SQL, for tables without repeated ids."""
    return f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS plain FROM {table}),
groups AS (SELECT plain, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY plain)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.plain) AS text_sha256
FROM texts t JOIN groups g ON t.plain = g.plain"""
