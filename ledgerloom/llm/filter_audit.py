"""Filter interaction audit: what each filter removes under every order of the filters, by parts of the corpus.

Each document's failed filters are a mask of bits. Documents are counted by part and mask, which is all that the orders
need: at most 2^n cells a part. The orders are visited by single swaps of neighbours (plain changes, Steinhaus-Johnson-
Trotter); a swap changes two steps alone, which are made anew from the cells, and each filter's removals are added to its
Shapley sum as often as the walk kept them. Parts are dealt over tasks, so their number is not bounded.

Filters (words: maximal runs of other characters than space and \\t to \\r):
A fewer than 200 words; B distinct words under half of all; C A-Z are over 2 % of the characters; D holds one of #$%&*|;
E the text is identical to that of a smaller id, table-wide.

Defined results: a null text is empty; a null part is the empty string; a null id is not smaller or larger than any id and
has no label; equal ids are not smaller than each other; of several labels of an id, one that says 1 is enough; labels may
be null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.repeats import salted_join
from ledgerloom.llm.scratch import materialize

FILTERS = "ABCDE"
PARTS_AT_ONCE = 64
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)
COUNTS = ("n", "good", "toxic")


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (of the filters A to D, from bit 0) and digest of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = rows.withColumn("words", words).select(
        "doc_id", "part", "text", F.size("words").cast("long").alias("total"), F.size(F.array_distinct("words")).cast("long").alias("distinct")
    )
    fails = (
        F.col("total") < 200,
        100 * F.col("distinct") < 50 * F.col("total"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask and the numbers of documents (n), of those with quality 1 (good) and with toxic 1 (toxic)."""
    rows = materialize(text_failures(docs, id_col, text_col, part_col), "failures")
    copies = rows.groupBy("digest").agg(F.count("*").alias("c"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    copies = materialize(copies.filter("least < most").select("digest", "c", "least"), "copies")
    marked = salted_join(rows, copies, ["digest"], ["doc_id"], "left")
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    marked = marked.select("doc_id", "part", mask.alias("mask"))
    flag = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    # Rows without an id have no label and would meet in one task; rows of one repeated id are split by the skew join.
    judged = marked.filter("doc_id is not null").join(said.filter("doc_id is not null").hint("merge"), "doc_id", "left")
    both = judged.select("part", "mask", "quality", "toxic").unionByName(
        marked.filter("doc_id is null").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    )
    total = lambda name, out: F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(out)
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality", "good"), total("toxic", "toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places j such that swapping the items at j and j + 1, one after the other, visits all orders of n items once."""
    order, back = list(range(n)), [True] * n
    while True:
        mobile = -1
        for i, item in enumerate(order):
            j = i - 1 if back[item] else i + 1
            if 0 <= j < n and order[j] < item and item > mobile:
                mobile, at, to = item, i, j
        if mobile < 0:
            return
        order[at], order[to] = order[to], order[at]
        for item in range(mobile + 1, n):
            back[item] = not back[item]
        yield min(at, to)


def walk(counts: np.ndarray, n: int) -> tuple[list[tuple], list[np.ndarray]]:
    """The steps of every order, and each filter's removals summed over all orders.

    counts: parts x 2^n masks x COUNTS. A visit is (order, steps); a step is (kept, removed, redundant, unique_fails, good_lost, toxic_lost).
    """
    masks = np.arange(1 << n)
    failing = [counts[:, masks >> f & 1 == 1, 0].sum(1) for f in range(n)]
    alone = [counts[:, 1 << f, 0] for f in range(n)]

    def step(f: int, before: int) -> tuple:
        lost = counts[:, (masks >> f & 1 == 1) & (masks & before == 0)].sum(1)
        kept = counts[:, masks & (before | 1 << f) == 0, 0].sum(1)
        return kept, lost[:, 0], failing[f] - lost[:, 0], alone[f], lost[:, 1], lost[:, 2]

    order = list(range(n))
    steps = [step(f, (1 << f) - 1) for f in order]
    visits, shapley, since = [(tuple(order), tuple(steps))], [np.zeros(len(counts), np.int64) for _ in order], [0] * n
    for j in plain_changes(n):
        for at in (j, j + 1):
            f = order[at]
            shapley[f] = shapley[f] + steps[at][1] * (len(visits) - since[f])
            since[f] = len(visits)
        order[j], order[j + 1] = order[j + 1], order[j]
        before = sum(1 << f for f in order[:j])
        steps[j], steps[j + 1] = step(order[j], before), step(order[j + 1], before | 1 << order[j])
        visits.append((tuple(order), tuple(steps)))
    for at, f in enumerate(order):
        shapley[f] = shapley[f] + steps[at][1] * (len(visits) - since[f])
    return visits, shapley


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of every part. counted: as from cells(). filters: a letter a bit of the mask."""
    n = len(filters)

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PARTS_AT_ONCE):
                rows = batch.slice(low, PARTS_AT_ONCE).to_pylist()
                counts = np.zeros((len(rows), 1 << n, len(COUNTS)), np.int64)
                for i, row in enumerate(rows):
                    for cell in row["cells"]:
                        counts[i, cell["mask"]] += [cell[c] for c in COUNTS]
                visits, shapley = walk(counts, n)
                orders = ["".join(filters[f] for f in order) for order, _ in visits for _ in order]
                figures = np.array([[*found, shapley[f]] for order, steps in visits for f, found in zip(order, steps)])  # (visit, step) x figure x part
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"] for row in rows for _ in orders], pa.string()), pa.array(orders * len(rows)),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(visits) * len(rows))), *map(pa.array, figures.transpose(1, 2, 0).reshape(figures.shape[1], -1)),
                    ],
                    names=[column.split()[0] for column in RESULT.split(", ")],
                )

    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 2^n cells at most
    return parts.mapInArrow(audit, RESULT)


def oracle_sql(docs: str = "documents", labels: str = "labels") -> str:
    """The same in DuckDB SQL, each order and step from the cells by itself."""
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words
  FROM {docs}),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM {labels} GROUP BY doc_id),
masks AS (
  SELECT t.part, coalesce(s.good, 0) AS good, coalesce(s.toxic, 0) AS toxic,
         CASE WHEN len(t.words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(t.words)) < 50 * len(t.words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 2 * length(t.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN t.doc_id > f.least THEN 16 ELSE 0 END AS mask
  FROM texts t JOIN firsts f ON t.text = f.text LEFT JOIN said s ON t.doc_id = s.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s.step, bits[s.step] AS bit, CAST(coalesce(list_sum(bits[1:s.step - 1]), 0) AS INTEGER) AS before
  FROM orders, (VALUES (1), (2), (3), (4), (5)) AS s(step)),
found AS (
  SELECT c.part, p.filter_order, p.step, p.bit,
         sum(CASE WHEN c.mask & (p.before | p.bit) = 0 THEN c.n ELSE 0 END) AS kept,
         sum(CASE WHEN c.mask & p.bit <> 0 AND c.mask & p.before = 0 THEN c.n ELSE 0 END) AS removed,
         sum(CASE WHEN c.mask & p.bit <> 0 AND c.mask & p.before <> 0 THEN c.n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.mask = p.bit THEN c.n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN c.mask & p.bit <> 0 AND c.mask & p.before = 0 THEN c.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN c.mask & p.bit <> 0 AND c.mask & p.before = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM cells c, steps p GROUP BY c.part, p.filter_order, p.step, p.bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found"""
