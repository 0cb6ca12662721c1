"""Competency queries over edges and facts. All are plans of windows, semi-joins and aggregates; none collects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions import ids, normalize
from ledgerloom.operators.common import first_of, ranked, union, written


def resolve_concept(nodes: DataFrame, aliases: DataFrame, concept: str, kind: str | None = None, strict: bool = False) -> DataFrame:
    """id of the nodes that a name stands for: its alias if there is one, else all nodes with that label (strict: the least)."""
    norm = normalize.normalize_alias(F.lit(concept))
    by_alias = aliases.filter(F.col("alias_norm") == norm).select(F.col("node_id").alias("id"))
    labelled = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    # Nodes are scanned once; what decides between the two is at most one row.
    known = F.broadcast(by_alias.limit(1).select(F.lit(True).alias("known")))
    by_label = labelled.filter(F.lower("label") == norm).select("id").join(known, F.col("known"), "left_anti")
    found = by_alias.unionByName(by_label).distinct()
    return found.agg(F.min("id").alias("id")).filter("id is not null") if strict else found


def companies_with_segment(edges: DataFrame, concept_ids: DataFrame) -> DataFrame:
    segments = edges.filter("predicate = 'HAS_SEGMENT'").select(F.col("subject_id").alias("company_id"), F.col("object_id").alias("id"))
    return segments.join(concept_ids, "id", "left_semi").select("company_id").distinct()


def primary_segment(edges: DataFrame, by: tuple[str, ...] = ("company_id", "period")) -> DataFrame:
    """company_id, period, segment_id, share_pct: the greatest share, ties to the lesser id; edges without a share don't count.

    Where all edges are of one period, `by` may be the company alone: what follows by company then needs no further shuffle.
    """
    shares = edges.filter("predicate = 'HAS_SEGMENT' and qualifier.share_pct is not null")
    shares = shares.select(F.col("subject_id").alias("company_id"), "period", F.col("object_id").alias("segment_id"), F.col("qualifier.share_pct").alias("share_pct"))
    best = shares.groupBy(*by).agg(F.min(F.struct((-F.col("share_pct")).alias("n"), "segment_id", "share_pct", "period")).alias("best"))
    return best.select("company_id", "best.period", "best.segment_id", "best.share_pct")


def consecutive_positive(facts: DataFrame, metric: str, since: str, fs_div: str = "CFS") -> DataFrame:
    """company_id, periods, least: companies whose recorded amounts from a period on are all above 0 (gaps are allowed)."""
    wanted = facts.filter((F.col("metric_key") == metric) & (F.col("fs_div") == fs_div))
    wanted = wanted.filter(ids.period_key(F.col("bsns_year"), F.col("fiscal_period")) >= ids.label_key(F.lit(since)))
    return wanted.groupBy("company_id").agg(F.count("*").alias("periods"), F.min("amount").alias("least")).filter("least > 0")


def screen(nodes: DataFrame, edges: DataFrame, facts: DataFrame, aliases: DataFrame, concept: str, since: str, metric: str = "operating_income", fs_div: str = "CFS") -> DataFrame:
    """company_id, label: companies whose primary segment is the concept, and whose metric was positive since a period.

    The primary segment is that of the year in `since`. Both restrictions reach the scans of edges and facts.
    """
    concept_ids = resolve_concept(nodes, aliases, concept, "segment")
    primary = primary_segment(edges.filter(F.col("period") == since[:4]), by=("company_id",)).withColumnRenamed("segment_id", "id")
    positive = consecutive_positive(facts, metric, since, fs_div).select("company_id")
    # Both sides have a row a company and lie by company already, so they meet before the concept is looked at.
    found = primary.join(positive, "company_id", "left_semi").join(concept_ids, "id", "left_semi").select("company_id")
    return found.join(nodes.filter("kind = 'company'").select(F.col("id").alias("company_id"), "label"), "company_id", "left")


def stakes(edges: DataFrame) -> DataFrame:
    owns = edges.filter("predicate = 'OWNS_STAKE_IN'")
    return owns.select(
        F.col("subject_id").alias("holder_id"), F.col("object_id").alias("company_id"), F.coalesce("period", F.lit("")).alias("period"),
        F.col("qualifier.stake_pct").alias("stake_pct"), F.coalesce("qualifier.is_largest", F.lit(False)).alias("is_largest")
    )


def largest_shareholders(edges: DataFrame) -> DataFrame:
    """company_id, period, place, holder_id, stake_pct: holders in each company's latest period, greatest stake first, unknown last."""
    held = stakes(edges)
    latest = held.groupBy("company_id").agg(F.max("period").alias("period"))
    order = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("stake_pct"), "holder_id")
    rows = held.join(latest, ["company_id", "period"])
    return rows.select("company_id", "period", F.row_number().over(order).alias("place"), "holder_id", "stake_pct")


def owned_companies(edges: DataFrame) -> DataFrame:
    """holder_id, company_id, period, stake_pct: each holding as last recorded."""
    return first_of(stakes(edges), ["holder_id", "company_id"], [F.desc("period"), F.desc_nulls_last("stake_pct")]).select("holder_id", "company_id", "period", "stake_pct")


def stake_changes(edges: DataFrame) -> DataFrame:
    """company_id, holder_id, from_period, to_period, delta between a holder's last two recorded periods; null if either is unknown."""
    per = Window.partitionBy("company_id", "holder_id").orderBy("period")
    rows = stakes(edges).withColumn("from_period", F.lag("period").over(per)).withColumn("before", F.lag("stake_pct").over(per)).withColumn("next", F.lead("period").over(per))
    last = rows.filter("next is null and from_period is not null")
    return last.select("company_id", "holder_id", "from_period", F.col("period").alias("to_period"), (F.col("stake_pct") - F.col("before")).alias("delta"))


def ownership_closure(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Extension: (holder_id, company_id, hops) reachable over latest holdings within a number of hops."""
    step = written(owned_companies(edges).select("holder_id", "company_id"), "holdings")  # read again for each hop
    pair, fronts = ["holder_id", "company_id"], [step.withColumn("hops", F.lit(1))]
    for hops in range(2, rounds + 1):
        reached = fronts[-1].select("holder_id", F.col("company_id").alias("via")).join(step.withColumnRenamed("holder_id", "via"), "via").select(*pair).distinct()
        # Only pairs that are new go on, and a front is written once: a hop costs its own pairs, not those of all before it.
        front = written(reached.join(union(*fronts).select(*pair), pair, "left_anti").withColumn("hops", F.lit(hops)), "front")
        if front.isEmpty():
            break
        fronts.append(front)
    return union(*fronts)


def company_summary(edges: DataFrame, top: int = 5, parts: int | None = None) -> DataFrame:
    """Extension: company_id, predicate, place, object_id, share_pct: what a company makes, as of its latest period.

    All its segments and the first customers and regions, by falling share, unknown shares last, ties to the lesser id.
    Edges are made and shuffled once, by company, over `parts` tasks if given: the latest period and the places are windows over that.
    """
    said = edges.filter(F.col("predicate").isin("HAS_SEGMENT", "SELLS_TO", "EXPOSED_TO")).select(
        F.col("subject_id").alias("company_id"), "predicate", "object_id", F.coalesce("period", F.lit("")).alias("period"), F.col("qualifier.share_pct").alias("share_pct")
    )
    dealt = said.repartition(parts, "company_id") if parts else said
    current = dealt.withColumn("_latest", F.max("period").over(Window.partitionBy("company_id"))).filter("period = _latest")
    placed = ranked(current, ["company_id", "predicate"], [F.desc_nulls_last("share_pct"), F.col("object_id")], "place")
    return placed.filter((F.col("predicate") == "HAS_SEGMENT") | (F.col("place") <= top)).select("company_id", "predicate", "place", "object_id", "share_pct")


def fiscal_years(edges: DataFrame) -> DataFrame:
    """company_id, year: the four-digit periods of each company's edges, as the years that it has reported."""
    return edges.filter(F.col("period").rlike(r"^\d{4}$")).select(F.col("subject_id").alias("company_id"), F.col("period").alias("year")).distinct()
