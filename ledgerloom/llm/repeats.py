"""Anchored runs of windows: the common first part of the exact-repeat operators.

A document's windows (of bytes or of words) are grouped into runs by their winnowed anchors: equal
windows always have equal anchors, so windows whose anchor occurs once in the corpus cannot repeat.
Only runs with a repeated anchor go on, which keeps the shuffle at about 2 / (span - gram) rows a window
and loses no repeat. Runs count as equal if their anchors and their contents' hashes, of 64 bits each, agree.

A row is named by its id and a hash of its text, so only rows with equal ids could ever be taken for each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from ledgerloom.llm import bytescan
from ledgerloom.llm.scratch import materialize

NO_ID = (1 << 63) - 1
RUNS = "anchor long, cover long, doc long, key long, pos long, n long"
ROW = ["doc", "key"]
HOT_KEYS = 512
SALTS = 32


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc (a null id stands after all others), key (of the text: rows equal in id and text share both) and text (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(F.col(id_col).cast("long").alias("id"), doc.alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def beside_text(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, bool]:
    """docs, the column to read texts from, and whether it was added (under a name that no column has).

    A column of strings is read as it is, so that texts go to Python once, not twice.
    """
    if docs.columns.count(text_col) == 1 and docs.schema[text_col].dataType == StringType():
        return docs, text_col, False
    mark = "k" * (max(map(len, docs.columns)) + 1)
    return docs.withColumn(mark, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), mark, True


def _scanner(span: int, gram: int, by_word: bool) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            texts = bytescan.column(batch, "text")
            keys, docs = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "doc"))
            for low, high in bytescan.chunks(texts):
                if by_word:
                    words = bytescan.Words(texts[low:high])
                    first, count = words.first, words.count
                    if not len(count) or count.max() < span:
                        continue
                    values = words.hashes()
                else:
                    count = np.fromiter(map(len, texts[low:high]), np.int64, high - low)
                    if count.max() < span:
                        continue
                    first = np.cumsum(count) - count
                    values = np.frombuffer(b"".join(texts[low:high]), np.uint8)
                owner, start, n, anchor, cover = bytescan.anchor_runs(values, first, count, span, gram)
                if len(owner):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (anchor, cover, docs[low + owner], keys[low + owner], start - first[owner], n)],
                        ["anchor", "cover", "doc", "key", "pos", "n"]
                    )

    return scan


def anchored_runs(rows: DataFrame, span: int, gram: int, by_word: bool) -> DataFrame:
    """All runs of all documents. rows: as from keyed()."""
    return rows.select("key", "doc", "text").mapInArrow(_scanner(span, gram, by_word), RUNS)


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with keys. counts (or keys itself): the number of rows of each key in column c, each key once.

    Keys that hold more than one in HOT_KEYS of all rows are spread over salts, one more for each such share of the rows, at
    most SALTS: keys' rows are repeated for all salts, of which rows take one by their hash of the columns `spread`. There are
    fewer than HOT_KEYS such keys whatever the table, so they may be broadcast, and fewer than 2 * HOT_KEYS rows are added to unique keys.
    """
    counts = keys if counts is None else counts
    total, most = counts.agg(F.sum("c"), F.max("c")).first()
    share = max(1, (total or 0) // HOT_KEYS)
    if (most or 0) <= share:
        return rows.join(keys.drop("c").hint("merge"), on, how)
    salts = F.least(F.lit(SALTS), F.ceil(F.col("c") / share)).cast("long")
    hot = F.broadcast(counts.filter(F.col("c") > share).select(*on, salts.alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    drawn = rows.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(*spread), salts)).drop("salts")
    dealt = keys.drop("c").join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return drawn.join(dealt.hint("merge"), [*on, "salt"], how).drop("salt")


def repeated_runs(runs: DataFrame, across_docs: bool) -> DataFrame:
    """The runs whose anchor occurs more than once (across_docs: under different document ids).

    The counts are combined before their shuffle and written, so that both sides of the semi-join are plain
    exchanges by anchor and salt.
    """
    counts = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    counts = materialize(counts.filter("lo < hi" if across_docs else "c > 1").select("anchor", "c"), "anchors")
    return salted_join(runs, counts, ["anchor"], ["doc", "key", "pos"], "left_semi")


def with_intervals(rows: DataFrame, intervals: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """rows with a column cut: the sorted distinct (start, end) intervals of the row, or null. Keeps every row.

    sizes: how much each (doc, key) holds, in column c; rows of large ones, which are alike, are salted by the task that read them.
    """
    per_key = intervals.distinct().groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("cut"))
    if sizes is None:
        return rows.join(per_key, ROW, "left")
    return salted_join(rows.withColumn("task", F.spark_partition_id()), per_key, ROW, ["task"], "left", sizes).drop("task")
