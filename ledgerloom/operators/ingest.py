"""Raw statement, shareholder, investment and extraction rows to facts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import ids, normalize
from ledgerloom.operators.common import first_of
from ledgerloom.schema import FLOW_METRICS

# Account ids and names to metrics, and the statements that a metric may come from.
METRIC_BY_ID = {
    "ifrs-full_Revenue": "revenue",
    "ifrs_Revenue": "revenue",
    "dart_OperatingIncomeLoss": "operating_income",
    "ifrs-full_ProfitLossFromOperatingActivities": "operating_income",
    "ifrs-full_ProfitLoss": "net_income",
    "ifrs-full_Assets": "assets",
    "ifrs-full_Liabilities": "liabilities",
    "ifrs-full_Equity": "equity",
    "ifrs-full_BasicEarningsLossPerShare": "eps",
    "ifrs-full_CashFlowsFromUsedInOperatingActivities": "cf_operating",
    "ifrs-full_CashFlowsFromUsedInInvestingActivities": "cf_investing",
    "ifrs-full_CashFlowsFromUsedInFinancingActivities": "cf_financing",
}
METRIC_BY_NAME = {
    "매출액": "revenue", "수익(매출액)": "revenue", "영업수익": "revenue",
    "영업이익": "operating_income", "영업이익(손실)": "operating_income",
    "당기순이익": "net_income", "당기순이익(손실)": "net_income",
    "자산총계": "assets", "부채총계": "liabilities", "자본총계": "equity",
    "기본주당이익(손실)": "eps", "기본주당순이익": "eps",
    "영업활동현금흐름": "cf_operating", "영업활동으로인한현금흐름": "cf_operating",
    "투자활동현금흐름": "cf_investing", "투자활동으로인한현금흐름": "cf_investing",
    "재무활동현금흐름": "cf_financing", "재무활동으로인한현금흐름": "cf_financing",
}
# The same table keyed by statement, as a row names its statement and asks for the metrics allowed there.
STATEMENTS = {
    "BS": ("assets", "liabilities", "equity", "shares_outstanding"), "IS": ("revenue", "operating_income", "net_income", "eps"),
    "CIS": ("revenue", "operating_income", "net_income", "eps"), "CF": ("cf_operating", "cf_investing", "cf_financing")
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.coalesce(F.trim(key), F.lit(""))]


def metric_of(account_id: Column, account_name: Column, statement: Column) -> Column:
    """The metric of an account by its id, else its name; null unless the statement may hold it."""
    metric = F.coalesce(_looked_up(METRIC_BY_ID, account_id), _looked_up(METRIC_BY_NAME, account_name))
    allowed = F.create_map(*(x for k, v in STATEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.coalesce(F.trim(statement), F.lit(""))]
    return F.when(F.array_contains(allowed, metric), metric)


def unpivot_years(
    rows: DataFrame, keys: list[str], year: str = "bsns_year", amounts: tuple[str, str, str] = ("current", "previous", "before"),
    flow: Column | None = None
) -> DataFrame:
    """A row each for the year, the year before and the one before that; rows that are no flow give the year alone. Missing amounts go."""
    steps = F.array(*(F.struct(F.lit(i).alias("back"), F.col(c).alias("amount")) for i, c in enumerate(amounts)))
    out = rows.select(*keys, F.col(year).alias("_year"), (flow if flow is not None else F.lit(True)).alias("_flow"), F.explode(steps).alias("s"))
    out = out.filter("s.amount is not null and (_flow or s.back = 0)")
    return out.select(*keys, (F.col("_year").cast("int") - F.col("s.back")).cast("string").alias("bsns_year"), F.col("s.amount").alias("amount"))


def parse_statements(rows: DataFrame, report_code: Column, company_code: Column) -> DataFrame:
    """Facts (company_id, bsns_year, fiscal_period, fs_div, metric_key, amount, report_year) of raw statement rows."""
    parsed = rows.select(
        ids.company_id(company_code).alias("company_id"), F.col("bsns_year"), ids.report_period(report_code).alias("fiscal_period"), "fs_div",
        metric_of(F.col("account_id"), F.col("account_nm"), F.col("sj_div")).alias("metric_key"), F.col("bsns_year").alias("report_year"),
        *(normalize.parse_amount(F.col(raw)).alias(to) for raw, to in (("thstrm_amount", "current"), ("frmtrm_amount", "previous"), ("bfefrmtrm_amount", "before"))),
    ).filter("metric_key is not null")
    return unpivot_years(parsed, ["company_id", "fiscal_period", "fs_div", "metric_key", "report_year"], flow=F.col("metric_key").isin(*FLOW_METRICS))


def prefer_consolidated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the consolidated statements; where a key has none, of the separate ones."""
    any_cfs = F.max(F.when(F.col("fs_div") == "CFS", 1).otherwise(0)).over(Window.partitionBy(*keys))
    return rows.withColumn("_any", any_cfs).filter("fs_div = 'CFS' or _any = 0").drop("_any")


def preferred_fact(facts: DataFrame) -> DataFrame:
    """For each company, period and metric the consolidated amount, else the separate one."""
    return first_of(facts, ["company_id", "bsns_year", "fiscal_period", "metric_key"], [F.desc(F.col("fs_div") == "CFS"), F.col("amount")])


def holder_edges(rows: DataFrame, company_code: Column, year: Column) -> DataFrame:
    """Stakes of a company's holders: no summary rows; of several share classes the greatest stake, then the first."""
    parsed = rows.select(
        "ordinal", company_code.alias("code"), year.alias("period"), F.trim("nm").alias("name"), "relate",
        normalize.parse_percent(F.col("trmend_posesn_stock_qota_rt")).alias("stake_pct"), normalize.parse_count(F.col("trmend_posesn_stock_co")).alias("shares"),
    ).filter(~normalize.is_summary(F.col("name")) & (F.coalesce("name", F.lit("")) != ""))
    kind = normalize.classify_shareholder(F.col("name"), F.col("relate"))
    holder = F.when(kind == "company", ids.external_company_id(F.col("name"))).otherwise(ids.person_id(F.col("name"), F.col("code")))
    edges = parsed.select(
        "ordinal", holder.alias("subject_id"), ids.company_id(F.col("code")).alias("object_id"), "period", "stake_pct", "shares",
        F.col("relate").alias("relation"), normalize.is_largest(F.col("relate")).alias("is_largest")
    )
    return first_of(edges, ["subject_id", "object_id", "period"], [F.desc_nulls_last("stake_pct"), F.col("ordinal")]).drop("ordinal")


def investment_edges(rows: DataFrame, company_code: Column, year: Column, compat: bool = False) -> DataFrame:
    """A company's stakes in others; the last row of a name wins. compat keeps summary rows."""
    parsed = rows.select(
        "ordinal", company_code.alias("code"), year.alias("period"), F.trim("inv_prm").alias("name"), F.col("invstmnt_purps").alias("purpose"),
        normalize.parse_percent(F.col("trmend_blce_qota_rt")).alias("stake_pct"), normalize.parse_count(F.col("trmend_blce_qy")).alias("shares")
    )
    parsed = parsed.filter(F.coalesce("name", F.lit("")) != "")
    if not compat:
        parsed = parsed.filter(~normalize.is_summary(F.col("name")))
    edges = parsed.select(
        "ordinal", ids.company_id(F.col("code")).alias("subject_id"), ids.external_company_id(F.col("name")).alias("object_id"), "period",
        "stake_pct", "shares", normalize.affiliation(F.col("stake_pct")).alias("affiliation_type"), "purpose"
    )
    return first_of(edges, ["subject_id", "object_id", "period"], [F.desc("ordinal")]).drop("ordinal")


def structure_edges(extractions: DataFrame) -> DataFrame:
    """Edges of extraction records (company_code, record, and rcept_no as source_ref if it is there): segments, customers and regions, as one union."""
    company = ids.company_id(F.col("company_code"))
    source = [F.col("rcept_no").alias("source_ref")] if "rcept_no" in extractions.columns else []

    def part(field: str, predicate: str, target, share: str) -> DataFrame:
        rows = extractions.select(company.alias("subject_id"), F.col("record.period").alias("period"), F.col("company_code"), *source, F.explode(f"record.{field}").alias("x"))
        tier = F.col("x.tier") if field == "customers" else F.lit(None).cast("string")
        return rows.select(
            "subject_id", F.lit(predicate).alias("predicate"), target.alias("object_id"), "period", F.col(f"x.{share}").alias("share_pct"), tier.alias("tier"),
            *(["source_ref"] if source else [])
        )

    segments = part("segments", "HAS_SEGMENT", ids.segment_id(F.col("x.name_ko"), F.col("company_code")), "share_pct")
    customers = part("customers", "SELLS_TO", ids.customer_id(F.col("x.name_raw")), "revenue_share_pct")
    regions = part("geographic", "EXPOSED_TO", ids.region_id(F.col("x.region_code")), "share_pct").filter("share_pct is not null")
    return segments.unionByName(customers).unionByName(regions)


def structure_nodes(extractions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (id, kind, label, attrs) that the edges of extraction records (company_code, rcept_no, record) lead to.

    Regions that are there keep their labels; of several spellings of one id the last report's, then the greatest, stays.
    """
    none = F.lit(None).cast("map<string,string>")

    def part(field: str, kind: str, name: str, target, attrs) -> DataFrame:
        rows = extractions.select("company_code", "rcept_no", F.explode(f"record.{field}").alias("x"))
        return rows.select("rcept_no", target.alias("id"), F.lit(kind).alias("kind"), F.col(f"x.{name}").alias("label"), attrs.alias("attrs"))

    owner = F.create_map(F.lit("company"), F.col("company_code"), F.lit("name"), F.col("x.name_ko"))
    segments = part("segments", "segment", "name_ko", ids.segment_id(F.col("x.name_ko"), F.col("company_code")), owner)
    customers = part("customers", "customer", "name_raw", ids.customer_id(F.col("x.name_raw")), none)
    regions = part("geographic", "region", "region_code", ids.region_id(F.col("x.region_code")), none).join(nodes.select("id"), "id", "left_anti")
    found = segments.unionByName(customers).unionByName(regions)
    return first_of(found, ["id"], [F.desc("rcept_no"), F.desc("label")]).drop("rcept_no")


def _problem() -> Column:
    bad_share = lambda a, f: F.exists(a, lambda x: (x[f] < 0) | (x[f] > 100))
    shares = (bad_share("record.segments", "share_pct"), bad_share("record.customers", "revenue_share_pct"), bad_share("record.geographic", "share_pct"))
    said = [F.coalesce(s, F.lit(False)) for s in shares]  # a share that is missing is no fault
    return (
        F.when(said[0] | said[1] | said[2], "share")
        .when(F.exists("record.customers", lambda x: ~x["tier"].isin("1차", "2차", "unknown")), "tier")
        .when(F.exists("record.geographic", lambda x: ~x["region_code"].isin("KR", "US", "EU", "CN", "JP", "ROW")), "region")
    )


def rejected_extractions(extractions: DataFrame) -> DataFrame:
    """company_code (and rcept_no if it is there), problem of records with shares outside 0..100 or unknown tiers or regions."""
    names = [c for c in ("company_code", "rcept_no") if c in extractions.columns]
    return extractions.select(*names, _problem().alias("problem")).filter("problem is not null")


def link(left: DataFrame, right: DataFrame, on: str, predicate: str, subject: Column, target: Column) -> DataFrame:
    """Edges between two tables that share a key."""
    return left.join(right, on).select(subject.alias("subject_id"), F.lit(predicate).alias("predicate"), target.alias("object_id"))


def link_sectors(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """company_code, sector_id, label of profiles (company_code, code) with names (code, name); unknown codes are named by the code."""
    label = F.coalesce("name", F.concat(F.lit("KSIC "), F.col("code")))
    return profiles.join(names, "code", "left").select("company_code", ids.sector_id(F.col("code")).alias("sector_id"), label.alias("label"))


def common_shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of a key whose kind starts as common stock."""
    return first_of(rows.filter(F.trim("se").startswith("보통")), keys, [F.col("ordinal")])


def holder_nodes(rows: DataFrame, company_code: Column) -> DataFrame:
    """Nodes (id, kind, label, attrs) of a company's holders; external companies say so. The last row of a name gives the label."""
    parsed = rows.select("ordinal", company_code.alias("code"), F.trim("nm").alias("name"), "relate").filter(
        ~normalize.is_summary(F.col("name")) & (F.coalesce("name", F.lit("")) != "")
    )
    company = normalize.classify_shareholder(F.col("name"), F.col("relate")) == "company"
    node = F.when(company, ids.external_company_id(F.col("name"))).otherwise(ids.person_id(F.col("name"), F.col("code")))
    none = F.lit(None).cast("map<string,string>")
    found = parsed.select(
        "ordinal", node.alias("id"), F.when(company, "company").otherwise("person").alias("kind"), F.col("name").alias("label"),
        F.when(company, F.create_map(F.lit("external"), F.lit("true"))).otherwise(none).alias("attrs")
    )
    return first_of(found, ["id"], [F.desc("ordinal")]).drop("ordinal")


def investment_nodes(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Nodes of the companies that others hold stakes in; all are external until they are resolved."""
    parsed = rows.select("ordinal", F.trim("inv_prm").alias("name")).filter(F.coalesce("name", F.lit("")) != "")
    parsed = parsed if compat else parsed.filter(~normalize.is_summary(F.col("name")))
    found = parsed.select(
        "ordinal", ids.external_company_id(F.col("name")).alias("id"), F.lit("company").alias("kind"), F.col("name").alias("label"),
        F.create_map(F.lit("external"), F.lit("true")).alias("attrs")
    )
    return first_of(found, ["id"], [F.desc("ordinal")]).drop("ordinal")


def equity_edges(holders: DataFrame, investments: DataFrame, report_code: str = "11011", compat: bool = False) -> DataFrame:
    """All stakes of the companies' annual reports, from both tables, with where each comes from.

    holders and investments: raw rows with ordinal, corp_code and bsns_year, of any number of companies and years.
    """
    code, year = F.col("corp_code"), F.col("bsns_year")
    null = lambda kind: F.lit(None).cast(kind)
    of = lambda c: F.concat(F.lit("dart:"), c, F.lit(":"), F.col("period"), F.lit(f":{report_code}"))
    held = holder_edges(holders, code, year).withColumns({"affiliation_type": null("string"), "purpose": null("string"), "source_ref": of(F.substring_index("object_id", ":", -1))})
    own = investment_edges(investments, code, year, compat).withColumns(
        {"relation": null("string"), "is_largest": null("boolean"), "source_ref": of(F.substring_index("subject_id", ":", -1))}
    )
    both = held.unionByName(own)
    qualifier = F.struct(
        "stake_pct", "shares", F.nullif(F.trim("relation"), F.lit("")).alias("relation"), "is_largest", "affiliation_type",
        F.nullif(F.trim("purpose"), F.lit("")).alias("purpose")
    )
    return both.select(
        "subject_id", F.lit("OWNS_STAKE_IN").alias("predicate"), "object_id", "period", qualifier.alias("qualifier"),
        F.lit("dart_api").alias("source_type"), "source_ref", F.lit("api").alias("method"), F.lit(1.0).alias("confidence")
    )


def share_facts(rows: DataFrame) -> DataFrame:
    """Facts of shares outstanding: each report's first row of common stock. rows: ordinal, corp_code, bsns_year, reprt_code, se, istc_totqy."""
    first = common_shares(rows, ["corp_code", "bsns_year", "reprt_code"])
    amount = normalize.parse_amount(F.col("istc_totqy"))
    found = first.select(
        ids.company_id(F.col("corp_code")).alias("company_id"), "bsns_year", ids.report_period(F.col("reprt_code")).alias("fiscal_period"),
        F.lit("CFS").alias("fs_div"), F.lit("shares_outstanding").alias("metric_key"), amount.alias("amount")
    )
    return found.filter("amount is not null and fiscal_period is not null")


def unseen_reports(extractions: DataFrame, edges: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Extractions (with rcept_no) of reports that no edge comes from yet and that are not on record (reports), so that none is ingested twice.

    A report whose edges a later one has all replaced is known from the record alone.
    """
    seen = edges.filter("source_ref is not null").select(F.col("source_ref").alias("rcept_no"))
    seen = seen if reports is None else seen.unionByName(reports.select("rcept_no"))
    return extractions.join(seen.distinct(), "rcept_no", "left_anti")


def accepted_extractions(extractions: DataFrame) -> DataFrame:
    """Extractions without a problem of their own (see rejected_extractions)."""
    return extractions.withColumn("_problem", _problem()).filter("_problem is null").drop("_problem")


# The labels of metric nodes.
METRIC_LABELS = {
    "revenue": "매출액", "operating_income": "영업이익", "net_income": "당기순이익", "assets": "자산총계", "liabilities": "부채총계", "equity": "자본총계",
    "eps": "기본주당순이익", "cf_operating": "영업활동현금흐름", "cf_investing": "투자활동현금흐름", "cf_financing": "재무활동현금흐름", "shares_outstanding": "발행주식수",
}


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Nodes (id, kind, label) of the metrics and periods that facts refer to, each once."""
    metrics = facts.select("metric_key").distinct()
    metrics = metrics.select(
        ids.metric_id(F.col("metric_key")).alias("id"), F.lit("metric").alias("kind"),
        F.coalesce(_looked_up(METRIC_LABELS, F.col("metric_key")), "metric_key").alias("label")
    )
    periods = facts.select("bsns_year", "fiscal_period").distinct()
    periods = periods.select(
        ids.period_id(F.col("bsns_year"), F.col("fiscal_period")).alias("id"), F.lit("period").alias("kind"),
        F.concat_ws(" ", "bsns_year", "fiscal_period").alias("label")
    )
    return metrics.unionByName(periods)


def missing_companies(codes: DataFrame, nodes: DataFrame, master: DataFrame) -> DataFrame:
    """Nodes (id, kind, label, attrs) of companies that are asked for (corp_code) and have no node: named by the register, else by the code."""
    wanted = codes.select("corp_code").distinct().withColumn("id", ids.company_id(F.col("corp_code"))).join(nodes.select("id"), "id", "left_anti")
    named = wanted.join(master.groupBy("corp_code").agg(F.min("corp_name").alias("name")), "corp_code", "left")
    label = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("corp_code"))
    return named.select("id", F.lit("company").alias("kind"), label.alias("label"), F.create_map(F.lit("dart_code"), F.col("corp_code")).alias("attrs"))
