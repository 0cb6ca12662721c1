"""Integrity checks and the ownership gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.common import first_of, union
from ledgerloom.operators.graph_query import stakes
from ledgerloom.schema import STOCK_METRICS

MIN_COVERAGE = 0.85
MAX_STAKES = 100.5


def interim_equals_fy(facts: DataFrame, metrics: tuple[str, ...] = STOCK_METRICS) -> DataFrame:
    """Interim facts whose amount is that of the same year's FY: a sign of a wrong period."""
    # Facts of one key and amount meet: at most one for each period, so one pass and no self-join.
    keys = ["company_id", "bsns_year", "metric_key", "fs_div", "amount"]
    wanted = facts.filter(F.col("metric_key").isin(*metrics) & F.col("amount").isNotNull())
    met = wanted.groupBy(*keys).agg(F.collect_set("fiscal_period").alias("periods")).filter(F.array_contains("periods", "FY") & (F.size("periods") > 1))
    return met.select("company_id", "bsns_year", "metric_key", "fs_div", F.explode(F.array_remove("periods", "FY")).alias("fiscal_period"), "amount")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Null periods group together."""
    return edges.groupBy("subject_id", "predicate", "object_id", "period").agg(F.count("*").alias("copies")).filter("copies > 1")


def orphan_facts(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    return facts.select("company_id").distinct().join(nodes.select(F.col("id").alias("company_id")), "company_id", "left_anti")


def nonpositive_equity(facts: DataFrame, metric: str = "equity") -> DataFrame:
    return facts.filter((F.col("metric_key") == metric) & (F.col("amount") <= 0)).select("company_id", "bsns_year", "fiscal_period", "fs_div", "amount")


def check_integrity(nodes: DataFrame, edges: DataFrame, facts: DataFrame, stock_metrics: tuple[str, ...] = STOCK_METRICS, equity: str = "equity") -> DataFrame:
    """code, severity, subject, detail of all findings: the four checks above in one pass over facts, nodes and edges each.

    Facts and nodes meet in one aggregate, without a join: a company's row says whether a node or a fact names it, and the rows of
    an amount hold the periods that state it.
    """
    key = ["company_id", "bsns_year", "metric_key", "fs_div", "amount"]
    stock = F.col("metric_key").isin(*stock_metrics) & F.col("amount").isNotNull()
    low = (F.col("metric_key") == equity) & (F.col("amount") <= 0)
    none = lambda c: F.lit(None).cast(facts.schema[c].dataType).alias(c)
    at = F.struct(F.col("fiscal_period").cast("string").alias("period"))
    # What a node or a fact says of its company, and an amount with a period where a check asks for it.
    company = lambda name, node: F.struct(F.lit(True).alias("whole"), F.col(name).alias("company_id"), *map(none, key[1:]), F.lit(node).alias("node"), F.lit(None).cast("struct<period:string>").alias("at"))
    amount = F.struct(F.lit(False).alias("whole"), *key, F.lit(False).alias("node"), at.alias("at"))
    said = facts.select(F.explode(F.array(company("company_id", False), F.when(stock | low, amount))).alias("x")).filter("x is not null")
    named = nodes.filter("id is not null").select(company("id", True).alias("x"))
    met = union(said, named).select("x.*").groupBy("whole", *key).agg(F.collect_list("at").alias("at"), F.bool_or("node").alias("node"))
    periods = F.transform("at", lambda p: p["period"])
    text = lambda *c: F.concat_ws(" ", *(F.coalesce(x.cast("string"), F.lit("-")) for x in c))
    issue = lambda code, severity, detail: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("company_id").alias("subject"), detail.alias("detail"))
    early = F.array_distinct(F.filter(periods, lambda p: p != "FY"))
    interim = F.when(~F.col("whole") & stock & F.array_contains(periods, "FY"), F.transform(
        early, lambda p: issue("interim_bs_equals_fy", "error", text(F.col("bsns_year"), F.col("metric_key"), p, F.col("fs_div")))
    ))
    nonpositive = F.when(~F.col("whole") & low, F.transform(periods, lambda p: issue("negative_or_zero_equity", "info", text(F.col("bsns_year"), p))))
    orphan = F.when(F.col("whole") & ~F.col("node"), F.array(issue("orphan_fact", "warn", F.lit(""))))
    empty = F.array().cast("array<struct<code:string,severity:string,subject:string,detail:string>>")
    found = met.select(F.inline(F.concat(*(F.coalesce(x, empty) for x in (interim, nonpositive, orphan)))))
    copies = duplicate_edges(edges).select(
        F.lit("duplicate_edge").alias("code"), F.lit("error").alias("severity"), F.col("subject_id").alias("subject"),
        text(*(F.col(c) for c in ("predicate", "object_id", "period", "copies"))).alias("detail")
    )
    return union(found, copies)


def universe(nodes: DataFrame) -> DataFrame:
    """Companies of the register: not external, with a code."""
    listed = nodes.filter("kind = 'company' and not id like 'company:ext:%'")
    return listed.filter(F.coalesce(F.col("attrs")["dart_code"], F.lit("")) != "").select("id")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: companies_total, companies_with_ownership (on either side), coverage."""
    owns = stakes(edges)
    either = owns.select(F.explode(F.array("holder_id", "company_id")).alias("id")).distinct()  # one pass over the edges
    marked = universe(nodes).join(either.withColumn("hit", F.lit(1)), "id", "left")
    counts = marked.agg(F.count("*").alias("companies_total"), F.count("hit").alias("companies_with_ownership"))
    share = F.coalesce(F.try_divide(F.col("companies_with_ownership").cast("double"), F.col("companies_total").cast("double")), F.lit(0.0))
    return counts.withColumn("coverage", F.round(share, 4))


def overstake(edges: DataFrame) -> DataFrame:
    """company_id, period, total: companies whose largest holders' stakes add up to too much in the latest period that has any."""
    held = stakes(edges).filter("is_largest and stake_pct is not null").groupBy("company_id", "period").agg(F.sum(F.col("stake_pct").cast("decimal(20,6)")).alias("total"))
    return first_of(held, ["company_id"], [F.desc("period")]).filter(F.col("total") > MAX_STAKES)


def verify_ownership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The gate's figures in one row, and ok. Edges and nodes are read once each."""
    largest = F.col("is_largest") & F.col("stake_pct").isNotNull()
    # Each stake counts for its company, with its figures, and for its holder, as a mention.
    side = lambda who, held: F.struct(F.col(who).alias("id"), F.lit(held).alias("held"))
    both = stakes(edges).select(F.explode(F.array(side("company_id", True), side("holder_id", False))).alias("x"), "period", "stake_pct", largest.alias("largest"))
    both = both.select("x.*", F.when(F.col("x.held"), F.col("period")).alias("period"), "stake_pct", "largest")
    per = both.groupBy("id", "held", "period").agg(
        F.count("*").alias("n"), F.count_if(F.col("stake_pct").isNull()).alias("nulls"), F.count_if("largest").alias("k"), F.sum(
            F.when(F.col("largest"), F.col("stake_pct").cast("decimal(20,6)"))
        ).alias("total"),
    )
    # The latest period with any largest holder decides.
    latest = F.max_by("total", F.when(F.col("held") & (F.col("k") > 0), F.col("period")))
    seen = per.groupBy("id").agg(
        F.sum(F.when(F.col("held"), F.col("n"))).alias("n"), F.sum(F.when(F.col("held"), F.col("nulls"))).alias("nulls"),
        F.coalesce(latest > MAX_STAKES, F.lit(False)).alias("over"), F.lit(True).alias("hit")
    )
    outside = F.col("id").like("company:ext:%")
    listed = (F.col("kind") == "company") & ~outside & (F.coalesce(F.col("attrs")["dart_code"], F.lit("")) != "")
    kinds = nodes.select("id", listed.alias("listed"), (F.col("kind") == "person").alias("person"), outside.alias("outside"))
    figures = kinds.join(seen, "id", "full_outer").agg(
        F.count_if("listed").alias("companies_total"), F.count_if(F.col("listed") & F.col("hit")).alias("companies_with_ownership"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("owns_edges"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_stake_pct_edges"), F.count_if("over").alias("overstake_companies"),
        F.count_if("person").alias("person_nodes"), F.count_if("outside").alias("external_company_nodes"),
    )
    share = F.coalesce(F.try_divide(F.col("companies_with_ownership").cast("double"), F.col("companies_total").cast("double")), F.lit(0.0))
    row = figures.withColumn("coverage", F.round(share, 4))
    return row.withColumn("ok", (F.col("coverage") >= MIN_COVERAGE) & (F.col("overstake_companies") == 0))
