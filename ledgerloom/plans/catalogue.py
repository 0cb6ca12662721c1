"""The registered queries over the star adapter, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import ids, normalize, text
from ledgerloom.operators import evaluation, extraction, graph_query, ingest, integrity, operations, pages, patterns, projection, sections, seeds, upsert
from ledgerloom.operators.common import dealt, union, written
from ledgerloom.plans.star import AMOUNT, SQL, Star, with_views
from ledgerloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONCEPT, SINCE = "Brand#19", "2001Q3"


def query(sql: str | None = None):
    def register(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# ---- graph queries

_PRIMARY = "prim AS (SELECT subject_id AS company_id, period, object_id AS segment_id, share_pct FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, period ORDER BY share_pct DESC, object_id) AS rn FROM seg) WHERE rn = 1)"
_KEY = "(CAST(bsns_year AS INT) * 10 + CASE fiscal_period WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 WHEN 'FY' THEN 4 ELSE 0 END)"
_POSITIVE = f"positive AS (SELECT company_id, count(*) AS periods, min(amount) AS least FROM facts WHERE metric_key = 'operating_income' AND fs_div = 'CFS' AND {_KEY} >= 20013 GROUP BY company_id HAVING min(amount) > 0)"


@query(with_views("seg") + f", {_PRIMARY} SELECT * FROM prim")
def primary_segment(s: Star) -> DataFrame:
    return graph_query.primary_segment(s.segment_edges())


@query(with_views("seg") + " SELECT DISTINCT subject_id AS company_id FROM seg WHERE object_id = 'segment:brand-19'")
def segment_concept_companies(s: Star) -> DataFrame:
    return graph_query.companies_with_segment(s.segment_edges(), graph_query.resolve_concept(s.nodes(), s.aliases(), CONCEPT, "segment"))


@query(with_views("seg") + ", hit AS (SELECT 'segment:brand-19' AS id) SELECT DISTINCT subject_id AS company_id FROM seg JOIN hit ON object_id = id")
def alias_concept_companies(s: Star) -> DataFrame:
    return graph_query.companies_with_segment(s.segment_edges(), graph_query.resolve_concept(s.nodes(), s.aliases(), " Flagship ", strict=True))


@query(with_views("facts") + f", {_POSITIVE} SELECT company_id, periods, CAST(least AS DOUBLE) AS least FROM positive")
def consecutive_positive(s: Star) -> DataFrame:
    return double(graph_query.consecutive_positive(s.facts(), "operating_income", SINCE), "least")


@query(
    with_views("seg", "facts", "companies") + f", {_PRIMARY}, {_POSITIVE} SELECT company_id, label FROM companies WHERE company_id IN (SELECT company_id FROM prim WHERE period = '2001' AND segment_id = 'segment:brand-19') AND company_id IN (SELECT company_id FROM positive)"
)
def screen(s: Star) -> DataFrame:
    return graph_query.screen(s.nodes(), s.segment_edges(), s.facts(), s.aliases(), CONCEPT, SINCE)


@query(with_views("stake") + """, latest AS (SELECT company_id, max(period) AS period FROM stake GROUP BY company_id)
SELECT company_id, period, row_number() OVER (PARTITION BY company_id ORDER BY stake_pct DESC, holder_id) AS place, holder_id, stake_pct FROM stake JOIN latest USING (company_id, period)""")
def largest_shareholders(s: Star) -> DataFrame:
    return graph_query.largest_shareholders(s.stake_edges())


_OWNED = "owned AS (SELECT holder_id, company_id, period, stake_pct FROM (SELECT *, row_number() OVER (PARTITION BY holder_id, company_id ORDER BY period DESC) AS rn FROM stake) WHERE rn = 1)"


@query(with_views("stake") + f", {_OWNED} SELECT * FROM owned")
def owned_companies(s: Star) -> DataFrame:
    return graph_query.owned_companies(s.stake_edges())


@query(with_views("stake") + """, steps AS (SELECT *, lag(period) OVER w AS from_period, lag(stake_pct) OVER w AS before, lead(period) OVER w AS following FROM stake WINDOW w AS (PARTITION BY company_id, holder_id ORDER BY period))
SELECT company_id, holder_id, from_period, period AS to_period, round(stake_pct - before, 6) AS delta FROM steps WHERE following IS NULL AND from_period IS NOT NULL""")
def stake_changes(s: Star) -> DataFrame:
    return graph_query.stake_changes(s.stake_edges()).withColumn("delta", F.round("delta", 6))


@query(with_views("seg") + """, step AS (SELECT DISTINCT subject_id AS holder_id, object_id AS company_id FROM seg WHERE share_pct >= 8 UNION SELECT DISTINCT object_id, 'group:' || right(object_id, 1) FROM seg WHERE share_pct >= 8)
SELECT holder_id, company_id, min(hops) AS hops FROM (SELECT holder_id, company_id, 1 AS hops FROM step UNION ALL SELECT a.holder_id, b.company_id, 2 FROM step a JOIN step b ON a.company_id = b.holder_id) GROUP BY ALL""")
def ownership_closure(s: Star) -> DataFrame:
    big = s.segment_edges().filter("qualifier.share_pct >= 8")
    first = big.select("subject_id", F.lit("OWNS_STAKE_IN").alias("predicate"), "object_id", "period", "qualifier")
    second = big.select(
        F.col("object_id").alias("subject_id"), F.lit("OWNS_STAKE_IN").alias("predicate"),
        F.concat(F.lit("group:"), F.expr("right(object_id, 1)")).alias("object_id"), "period", "qualifier"
    )
    return graph_query.ownership_closure(first.unionByName(second), rounds=3)


# ---- integrity

_INTERIM = "SELECT i.company_id, i.bsns_year, i.metric_key, i.fs_div, i.fiscal_period, CAST(i.amount AS DOUBLE) AS amount FROM f i JOIN f y ON i.company_id = y.company_id AND i.bsns_year = y.bsns_year AND i.metric_key = y.metric_key AND i.fs_div = y.fs_div AND y.fiscal_period = 'FY' AND i.fiscal_period <> 'FY' AND i.amount = y.amount"
_COARSE = ", f AS (SELECT company_id, bsns_year, metric_key, fs_div, fiscal_period, CAST(floor(amount / 100000) AS DECIMAL(18,0)) AS amount FROM facts)"


def _coarse(s: Star) -> DataFrame:
    """Facts in units large enough that some amounts agree."""
    return s.facts().withColumn("amount", F.floor(F.col("amount") / 100000).cast("decimal(18,0)"))


@query(with_views("facts") + _COARSE + " " + _INTERIM)
def interim_equals_fy(s: Star) -> DataFrame:
    return double(integrity.interim_equals_fy(_coarse(s), ("revenue", "operating_income")), "amount")


def _line_edges(s: Star) -> DataFrame:
    return s.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("subject_id"), F.lit("HAS_SEGMENT").alias("predicate"),
        F.col("l_linenumber").cast("string").alias("object_id"), F.when(F.col("l_linestatus") == "F", F.lit("F")).alias("period")
    )


_DUPLICATES = "SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'HAS_SEGMENT' AS predicate, CAST(l_linenumber AS VARCHAR) AS object_id, CASE WHEN l_linestatus = 'F' THEN 'F' END AS period, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"


@query(_DUPLICATES)
def duplicate_edge(s: Star) -> DataFrame:
    return integrity.duplicate_edges(_line_edges(s))


@query(with_views("facts", "companies") + " SELECT DISTINCT company_id FROM facts WHERE company_id NOT IN (SELECT company_id FROM companies WHERE nation >= 5)")
def orphan_fact(s: Star) -> DataFrame:
    return integrity.orphan_facts(s.facts(), s.companies().filter("nation >= 5").withColumnRenamed("company_id", "id"))


@query(
    with_views("facts") + " SELECT company_id, bsns_year, fiscal_period, fs_div, CAST(amount AS DOUBLE) AS amount FROM facts WHERE metric_key = 'operating_income' AND amount <= 0"
)
def nonpositive_equity(s: Star) -> DataFrame:
    return double(integrity.nonpositive_equity(s.facts(), "operating_income"), "amount")


_ISSUES = f"""issues AS (
  SELECT 'interim_bs_equals_fy' AS code, 'error' AS severity, company_id AS subject, bsns_year || ' ' || metric_key || ' ' || fiscal_period || ' ' || fs_div AS detail FROM ({_INTERIM})
  UNION ALL SELECT 'duplicate_edge', 'error', subject_id, predicate || ' ' || object_id || ' ' || coalesce(period, '-') || ' ' || copies FROM ({_DUPLICATES})
  UNION ALL SELECT DISTINCT 'orphan_fact', 'warn', company_id, '' FROM f WHERE company_id NOT IN (SELECT company_id FROM companies WHERE nation >= 5)
  UNION ALL SELECT 'negative_or_zero_equity', 'info', company_id, bsns_year || ' ' || fiscal_period FROM f WHERE metric_key = 'operating_income' AND amount <= 0)"""


def _issues(s: Star) -> DataFrame:
    nodes = s.companies().filter("nation >= 5").withColumnRenamed("company_id", "id")
    return integrity.check_integrity(nodes, _line_edges(s), _coarse(s), ("revenue", "operating_income"), "operating_income")


@query(with_views("facts", "companies") + f"{_COARSE}, {_ISSUES} SELECT * FROM issues")
def integrity_union(s: Star) -> DataFrame:
    return _issues(s)


@query(
    with_views("facts", "companies") + f"{_COARSE}, {_ISSUES} SELECT severity, CASE severity WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END AS place, count(*) AS n FROM issues GROUP BY ALL"
)
def qa_summary(s: Star) -> DataFrame:
    return projection.qa_summary(_issues(s))


@query(with_views("facts", "companies") + f"""{_COARSE}, {_ISSUES}, n AS (SELECT severity, count(*) AS n FROM issues GROUP BY ALL), of AS (SELECT coalesce(sum(n), 0) AS total, coalesce(max(n) FILTER (severity = 'error'), 0) AS e, coalesce(max(n) FILTER (severity = 'warn'), 0) AS w, coalesce(max(n) FILTER (severity = 'info'), 0) AS i FROM n)
SELECT CAST(CASE severity WHEN 'error' THEN 11 WHEN 'warn' THEN 21 ELSE 31 END AS INT) AS place, subject, '| ' || code || ' | ' || subject || ' | ' || detail || ' |' AS line FROM issues
UNION ALL SELECT CAST(CASE severity WHEN 'error' THEN 10 WHEN 'warn' THEN 20 ELSE 30 END AS INT), '', chr(10) || '## ' || severity || ' (' || n || ')' || chr(10) || chr(10) || '| code | subject | message |' || chr(10) || '|------|---------|---------|' FROM n
UNION ALL SELECT 0, '', array_to_string(['---', 'type: "qa-report"', 'tags: [qa-report]', '---', '# 온톨로지 무결성 리포트', '', '', '- 총 이슈: ' || total, '- error: ' || e || ' · warn: ' || w || ' · info: ' || i, ''], chr(10)) FROM of""")
def qa_report(s: Star) -> DataFrame:
    return projection.qa_report(written(_issues(s), "issues"))  # counted and listed


_PART_STAKES = ", st AS (SELECT * FROM stake WHERE stake_pct < 20)"
_COVERAGE = "cover AS (SELECT count(*) AS companies_total, count(*) FILTER (company_id IN (SELECT company_id FROM st UNION SELECT holder_id FROM st)) AS companies_with_ownership FROM companies)"


def _part_stakes(s: Star) -> DataFrame:
    return s.stake_edges().filter("qualifier.stake_pct < 20")


@query(with_views("stake", "companies") + f"{_PART_STAKES}, {_COVERAGE} SELECT *, round(CAST(companies_with_ownership AS DOUBLE) / companies_total, 4) AS coverage FROM cover")
def coverage(s: Star) -> DataFrame:
    return integrity.coverage(s.nodes(), _part_stakes(s))


_OVER = "over_ AS (SELECT company_id, period, total FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY period DESC) AS rn FROM (SELECT company_id, period, sum(CAST(4 * stake_pct AS DECIMAL(20,6))) AS total FROM stake WHERE is_largest GROUP BY ALL)) WHERE rn = 1 AND total > 100.5)"


@query(with_views("stake") + f", {_OVER} SELECT company_id, period, round(CAST(total AS DOUBLE), 4) AS total FROM over_")
def overstake(s: Star) -> DataFrame:
    scaled = s.stake_edges().withColumn("qualifier", F.col("qualifier").withField("stake_pct", F.col("qualifier.stake_pct") * 4))
    return integrity.overstake(scaled).withColumn("total", F.round(F.col("total").cast("double"), 4))


@query(with_views("stake", "companies") + f"""{_PART_STAKES}, {_COVERAGE}, totals AS (SELECT company_id, period, sum(CAST(stake_pct AS DECIMAL(20,6))) AS total, row_number() OVER (PARTITION BY company_id ORDER BY period DESC) AS rn FROM st WHERE is_largest GROUP BY company_id, period),
figures AS (SELECT *, round(CAST(companies_with_ownership AS DOUBLE) / companies_total, 4) AS coverage, (SELECT count(*) FROM st) AS owns_edges, CAST(0 AS BIGINT) AS null_stake_pct_edges, (SELECT count(*) FROM customer) AS person_nodes, CAST(0 AS BIGINT) AS external_company_nodes, (SELECT count(*) FROM totals WHERE rn = 1 AND total > 100.5) AS overstake_companies FROM cover)
SELECT *, coverage >= 0.85 AND overstake_companies = 0 AS ok FROM figures""")
def verify_ownership(s: Star) -> DataFrame:
    return integrity.verify_ownership(s.nodes(), _part_stakes(s))


# ---- ingest

_YEARLY = f"yearly AS (SELECT l_suppkey, year(l_shipdate) AS y, sum({AMOUNT}) AS amount FROM lineitem GROUP BY ALL)"


def _three_years(s: Star) -> DataFrame:
    """A row a supplier and year with its own amount and those of the two years before."""
    yearly = s.table("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.sum(F.expr(AMOUNT)).alias("current"))
    back = lambda n: F.expr(f"max(current) OVER (PARTITION BY l_suppkey ORDER BY y RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)")
    return yearly.select("l_suppkey", F.col("y").cast("string").alias("bsns_year"), "current", back(1).alias("previous"), back(2).alias("before"))


@query(
    f"WITH {_YEARLY} SELECT r.l_suppkey, CAST(r.y AS VARCHAR) AS report_year, CAST(d.y AS VARCHAR) AS bsns_year, CAST(d.amount AS DOUBLE) AS amount FROM yearly r JOIN yearly d ON r.l_suppkey = d.l_suppkey AND d.y BETWEEN r.y - 2 AND r.y AND (r.l_suppkey % 3 > 0 OR d.y = r.y)"
)
def fact_unpivot(s: Star) -> DataFrame:
    rows = _three_years(s).withColumn("report_year", F.col("bsns_year"))
    return double(ingest.unpivot_years(rows, ["l_suppkey", "report_year"], flow=F.col("l_suppkey") % 3 > 0), "amount")


@query(
    with_views("facts") + " SELECT company_id, bsns_year, fiscal_period, fs_div, metric_key, CAST(amount AS DOUBLE) AS amount FROM facts f WHERE fs_div = 'CFS' OR NOT EXISTS (SELECT 1 FROM facts c WHERE c.company_id = f.company_id AND c.bsns_year = f.bsns_year AND c.fiscal_period = f.fiscal_period AND c.fs_div = 'CFS')"
)
def fs_div_fallback(s: Star) -> DataFrame:
    return double(ingest.prefer_consolidated(s.facts(), ["company_id", "bsns_year", "fiscal_period"]), "amount")


_PREFERRED = "pref AS (SELECT company_id, bsns_year, fiscal_period, fs_div, metric_key, amount FROM (SELECT *, row_number() OVER (PARTITION BY company_id, bsns_year, fiscal_period, metric_key ORDER BY fs_div = 'CFS' DESC, amount) AS rn FROM facts) WHERE rn = 1)"


@query(with_views("facts") + f", {_PREFERRED} SELECT company_id, bsns_year, fiscal_period, fs_div, metric_key, CAST(amount AS DOUBLE) AS amount FROM pref")
def cfs_preferred(s: Star) -> DataFrame:
    return double(ingest.preferred_fact(s.facts()), "amount")


@query("""WITH parsed AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS code, CAST(year(l_shipdate) AS VARCHAR) AS period, CASE WHEN l_partkey % 7 = 0 THEN '합계' WHEN l_partkey % 3 = 0 THEN 'Holder ' || l_partkey % 11 || ' Inc' ELSE 'Holder ' || l_partkey % 11 END AS nm,
   CASE WHEN l_linenumber = 1 THEN '최대주주 본인' WHEN l_linenumber = 2 THEN '계열회사 임원' ELSE '계열회사' END AS relate, CASE WHEN l_tax > 0.01 THEN l_tax * 100 END AS pct, l_quantity AS q FROM lineitem),
edges AS (SELECT *, CASE WHEN nm LIKE '%Inc' OR relate = '계열회사' THEN 'company:ext:' ELSE 'person:' || code || ':' END || trim(regexp_replace(lower(nm), '[^0-9a-z가-힣]+', '-', 'g'), '-') AS subject_id FROM parsed WHERE nm <> '합계')
SELECT subject_id, 'company:' || code AS object_id, period, round(pct, 4) AS stake_pct, CAST(q AS BIGINT) AS shares, relate AS relation, relate LIKE '최대주주%' AS is_largest FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, code, period ORDER BY round(pct, 4) DESC NULLS LAST, ordinal, q, relate) AS rn FROM edges) WHERE rn = 1""")
def max_stake_holder(s: Star) -> DataFrame:
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    number = F.concat(F.lit("Holder "), (part % 11).cast("string"))
    name = F.when(part % 7 == 0, "합계").when(part % 3 == 0, F.concat(number, F.lit(" Inc"))).otherwise(number)
    relate = F.when(line == 1, "최대주주 본인").when(line == 2, "계열회사 임원").otherwise("계열회사")
    percent = F.when(F.col("l_tax") > 0.01, F.concat(F.format_string("%.4f", F.col("l_tax") * 100), F.lit("%"))).otherwise("-")
    rows = s.table("lineitem").select(
        F.struct(
            (F.col("l_orderkey") * 10 + line).alias("a"), F.col("l_quantity").alias("b"), relate.alias("c")
        ).alias("ordinal"), s.code("l_suppkey").alias("corp_code"), F.year("l_shipdate").cast("string").alias("year"),
        name.alias("nm"), relate.alias("relate"), percent.alias("trmend_posesn_stock_qota_rt"), F.format_string("%,.0f", F.col("l_quantity")).alias("trmend_posesn_stock_co"),
    )
    return ingest.holder_edges(rows, F.col("corp_code"), F.col("year"))


@query(with_views("seg") + """ SELECT subject_id, predicate, 'segment:' || right(subject_id, 8) || ':' || ltrim(right(object_id, 8), ':') AS object_id, period, share_pct, CAST(NULL AS VARCHAR) AS tier FROM seg
UNION ALL SELECT subject_id, 'SELLS_TO', 'customer:' || ltrim(right(object_id, 8), ':') || '-co', period, share_pct / 2, CASE WHEN share_pct > 5 THEN '1차' ELSE 'unknown' END FROM seg
UNION ALL SELECT subject_id, 'EXPOSED_TO', 'region:KR', period, share_pct, NULL FROM seg WHERE share_pct > 4""")
def structure_explode(s: Star) -> DataFrame:
    share, name = F.col("qualifier.share_pct"), F.expr("ltrim(':', right(object_id, 8))")
    one = s.segment_edges().select(F.expr("right(subject_id, 8)").alias("company_code"), F.struct(
        F.col("period"),
        F.array(F.struct(name.alias("name_ko"), share.alias("share_pct"))).alias("segments"),
        F.array(
            F.struct(F.concat(name, F.lit(" Co.")).alias("name_raw"), (share / 2).alias("revenue_share_pct"), F.when(share > 5, "1차").otherwise("unknown").alias("tier"))
        ).alias("customers"),
        F.array(F.struct(F.lit("KR").alias("region_code"), F.when(share > 4, share).alias("share_pct"))).alias("geographic"),
    ).alias("record"))
    return ingest.structure_edges(one)


@query(
    "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS company_code, 'sector:' || s_nationkey AS sector_id, coalesce(n_name, 'KSIC ' || s_nationkey) AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = s_nationkey"
)
def link_sector(s: Star) -> DataFrame:
    profiles = s.companies().select(F.col("dart_code").alias("company_code"), F.col("nation").cast("string").alias("code"))
    names = s.table("nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return ingest.link_sectors(profiles, names)


@query(
    "SELECT 'company:' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS subject_id, 'ISSUES_STOCK' AS predicate, 'stock:' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS object_id FROM supplier JOIN part ON s_suppkey = p_partkey AND p_size > 10"
)
def link_stock(s: Star) -> DataFrame:
    stocks = s.table("part").filter("p_size > 10").select(s.code("p_partkey").alias("dart_code"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("ticker"))
    return ingest.link(s.companies(), stocks, "dart_code", "ISSUES_STOCK", F.col("company_id"), ids.stock_id(F.col("ticker")))


@query(
    "SELECT l_suppkey, ordinal, se, shares FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_returnflag = 'A' THEN '우선주' ELSE '보통주' END AS se, CAST(l_quantity AS BIGINT) AS shares, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_quantity) AS rn FROM lineitem WHERE l_returnflag <> 'A') WHERE rn = 1"
)
def shares_first_common(s: Star) -> DataFrame:
    rows = s.table("lineitem").select(
        "l_suppkey", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_quantity").alias("ordinal"),
        F.when(F.col("l_returnflag") == "A", "우선주").otherwise("보통주").alias("se"), F.col("l_quantity").cast("long").alias("shares")
    )
    return ingest.common_shares(rows, ["l_suppkey"]).select("l_suppkey", F.col("ordinal.a").alias("ordinal"), "se", "shares")


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'revenue' WHEN 1 THEN 'operating_income' WHEN 2 THEN 'equity' WHEN 3 THEN NULL WHEN 4 THEN 'net_income' ELSE NULL END AS metric FROM part"""
)
def metric_of(s: Star) -> DataFrame:
    k = F.col("p_size") % 6
    account = F.when(k == 0, "ifrs-full_Revenue").when(k == 2, "ifrs-full_Equity").when(k == 3, "ifrs-full_Equity").when(k == 5, "ifrs-full_GrossProfit").otherwise("")
    name = F.when(k == 1, "영업이익(손실)").when(k == 4, " 당기순이익 ").otherwise("")
    statement = F.when(k == 2, "BS").when(k == 3, "SCE").when(k == 1, "IS").otherwise("CIS")
    return s.table("part").select("p_partkey", ingest.metric_of(account, name, statement).alias("metric"))


def _investments(s: Star) -> DataFrame:
    """Orders as stakes in other companies."""
    name = F.when(F.col("o_orderstatus") == "P", "합계").otherwise(F.concat(F.lit("Target "), (F.col("o_orderkey") % 23).cast("string"), F.lit(" Inc")))
    stake = F.when(F.col("o_orderpriority").startswith("1"), "-").otherwise(F.format_string("%.2f", F.col("o_orderkey") % 100 + 0.5))
    return s.table("orders").select(
        F.col("o_orderkey").alias("ordinal"), s.code("o_custkey").alias("corp_code"), F.year("o_orderdate").cast("string").alias("bsns_year"),
        name.alias("inv_prm"), F.col("o_orderpriority").alias("invstmnt_purps"), stake.alias("trmend_blce_qota_rt"),
        F.format_string("%,d", F.col("o_orderkey")).alias("trmend_blce_qy")
    )


_INVESTED = """invested AS (SELECT 'company:' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS subject_id, 'company:ext:target-' || o_orderkey % 23 || '-inc' AS object_id, CAST(year(o_orderdate) AS VARCHAR) AS period, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderkey % 100 + 0.5 END AS stake_pct, o_orderkey AS shares, o_orderpriority AS purpose
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 23, year(o_orderdate) ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1)"""


@query(f"WITH {_INVESTED} SELECT *, CASE WHEN stake_pct >= 50 THEN '자회사' WHEN stake_pct >= 20 THEN '관계회사' ELSE '기타' END AS affiliation_type FROM invested")
def investment_edges(s: Star) -> DataFrame:
    return double(ingest.investment_edges(_investments(s), F.col("corp_code"), F.col("bsns_year")), "stake_pct")


@query(
    "SELECT 'company:ext:target-' || o_orderkey % 23 || '-inc' AS id, 'company' AS kind, 'Target ' || o_orderkey % 23 || ' Inc' AS label, 'true' AS external FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderkey % 23"
)
def investment_nodes(s: Star) -> DataFrame:
    return ingest.investment_nodes(_investments(s)).select("id", "kind", "label", F.col("attrs")["external"].alias("external"))


def _holders(s: Star) -> DataFrame:
    """Lines as holders of the companies that sold them."""
    name = F.when(F.col("l_linenumber") == 7, "계").when(
        F.col("l_returnflag") == "R", F.concat(F.lit("Fund "), (F.col("l_partkey") % 9).cast("string"), F.lit(" Ltd."))
    ).otherwise(F.concat(F.lit("Kim "), (F.col("l_partkey") % 9).cast("string")))
    ordinal = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_quantity").alias("d"))
    return s.table("lineitem").select(
        ordinal.alias("ordinal"), s.code("l_suppkey").alias("corp_code"), F.year("l_shipdate").cast("string").alias("bsns_year"), name.alias("nm"),
        F.when(F.col("l_linestatus") == "F", "본인").otherwise(" ").alias("relate"),
        F.format_string("%.1f", F.col("l_quantity")).alias("trmend_posesn_stock_qota_rt"), F.lit("-").alias("trmend_posesn_stock_co")
    )


_HELD = """held AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'company:ext:fund-' || l_partkey % 9 || '-ltd' ELSE 'person:' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || ':kim-' || l_partkey % 9 END AS subject_id, 'company:' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS object_id, CAST(year(l_shipdate) AS VARCHAR) AS period, max(l_quantity) AS stake_pct FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL)"""


@query(
    f"WITH {_INVESTED}, {_HELD} SELECT subject_id, object_id, period, CAST(stake_pct AS DOUBLE) AS stake_pct, 'dart:' || right(object_id, 8) || ':' || period || ':11011' AS source_ref FROM held UNION ALL SELECT subject_id, object_id, period, CAST(stake_pct AS DOUBLE), 'dart:' || right(subject_id, 8) || ':' || period || ':11011' FROM invested"
)
def equity_edges(s: Star) -> DataFrame:
    return ingest.equity_edges(_holders(s), _investments(s)).select("subject_id", "object_id", "period", F.col("qualifier.stake_pct").alias("stake_pct"), "source_ref")


@query(
    "SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'company:ext:fund-' || l_partkey % 9 || '-ltd' ELSE 'person:' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || ':kim-' || l_partkey % 9 END AS id, CASE WHEN l_returnflag = 'R' THEN 'company' ELSE 'person' END AS kind, CASE WHEN l_returnflag = 'R' THEN 'Fund ' || l_partkey % 9 || ' Ltd.' ELSE 'Kim ' || l_partkey % 9 END AS label FROM lineitem WHERE l_linenumber <> 7"
)
def holder_nodes(s: Star) -> DataFrame:
    return ingest.holder_nodes(_holders(s), F.col("corp_code")).select("id", "kind", "label")


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unseen_reports(s: Star) -> DataFrame:
    edges = s.table("lineitem").select(F.when(F.col("l_returnflag") == "R", F.lpad(F.col("l_orderkey").cast("string"), 14, "0")).alias("source_ref"))
    return ingest.unseen_reports(s.listed().select("rcept_no"), edges)


@query(
    "SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS company_code, CASE WHEN p_size > 40 THEN 'share' WHEN p_brand LIKE '%3' THEN 'tier' ELSE 'region' END AS problem FROM part WHERE p_size > 40 OR p_brand LIKE '%3' OR p_type LIKE '%BRASS'"
)
def rejected_extractions(s: Star) -> DataFrame:
    record = F.struct(
        F.array(F.struct(F.col("p_name").alias("name_ko"), (F.col("p_size") * 2.5).alias("share_pct"))).alias("segments"),
        F.array(
            F.struct(F.lit(None).cast("double").alias("revenue_share_pct"), F.when(F.col("p_brand").endswith("3"), "3차").otherwise("unknown").alias("tier"))
        ).alias("customers"),
        F.array(F.struct(F.when(F.col("p_type").endswith("BRASS"), "XX").otherwise("KR").alias("region_code"), F.lit(50.0).alias("share_pct"))).alias("geographic"),
    )
    return ingest.rejected_extractions(s.table("part").select(s.code("p_partkey").alias("company_code"), record.alias("record")))


def _answers(s: Star) -> DataFrame:
    """Answers whose text is made of each part's columns, with faults of every kind."""
    part, size = s.table("part"), F.col("p_size")
    share = (
        F.when(F.col("p_type") == "LARGE", F.concat(F.lit('"about '), size * 2.5, F.lit('%"'))).when(F.col("p_type") == "PROMO", F.lit('"n/a"'))
        .otherwise((size * 2.5).cast("string"))
    )
    brand = lambda end, text, other="": F.when(F.col("p_brand").endswith(end), text).otherwise(other)
    record = F.concat(
        F.lit("{"), brand("4", "", '"period": "2024", '), F.lit('"segments": [{"name_ko": "'), "p_name", F.lit('", "share_pct": '), share,
        brand("2", ', "note": 1'), F.lit('}], "customers": [{"name_raw": "'), "p_brand", F.lit('"'), brand("3", ', "tier": "3차"', ', "tier": "1차"'),
        F.lit('}], "geographic": [{"region_code": "'), F.when(F.col("p_type") == "SMALL", "XX").otherwise("KR"),
        F.lit('", "share_pct": 50}, {"region_code": "YY", "share_pct": null}]}')
    )
    said = F.when(size == 10, "there is no record").otherwise(F.concat(brand("1", "```json\n"), record, brand("1", "\n```")))
    return extraction.parse_answers(dealt(part.select("p_partkey", said.alias("answer"))))


@query("""WITH p AS (SELECT *, p_size * 2.5 AS share FROM part WHERE p_size <> 10)
SELECT p_partkey, '$' AS path, 'json' AS fault FROM part WHERE p_size = 10
UNION ALL SELECT p_partkey, '$.period', 'missing' FROM p WHERE p_brand LIKE '%4'
UNION ALL SELECT p_partkey, '$.segments[0].note', 'extra' FROM p WHERE p_brand LIKE '%2'
UNION ALL SELECT p_partkey, '$.segments[0].share_pct', 'number' FROM p WHERE p_type = 'PROMO'
UNION ALL SELECT p_partkey, '$.segments[0].share_pct', 'range' FROM p WHERE p_type <> 'PROMO' AND share > 100
UNION ALL SELECT p_partkey, '$.customers[0].tier', 'choice' FROM p WHERE p_brand LIKE '%3'
UNION ALL SELECT p_partkey, '$.geographic[0].region_code', 'choice' FROM p WHERE p_type = 'SMALL'""")
def extraction_faults(s: Star) -> DataFrame:
    return extraction.rejects(_answers(s), ["p_partkey"])


@query("""SELECT p_partkey, '2024' AS period, p_name AS segment, CAST(p_size * 2.5 AS DOUBLE) AS share, p_brand AS customer, '1차' AS tier, 1 AS regions
FROM part WHERE p_size <> 10 AND p_size * 2.5 <= 100 AND p_type <> 'PROMO' AND p_type <> 'SMALL' AND right(p_brand, 1) NOT IN ('2', '3', '4')""")
def extraction_records(s: Star) -> DataFrame:
    r = _answers(s).filter("record is not null").select("p_partkey", "record.*")
    return r.select(
        "p_partkey", "period", F.col("segments")[0]["name_ko"].alias("segment"), F.col("segments")[0]["share_pct"].alias("share"),
        F.col("customers")[0]["name_raw"].alias("customer"), F.col("customers")[0]["tier"].alias("tier"), F.size("geographic").alias("regions")
    )


# ---- upserts and resolution

@query("""WITH batch AS (SELECT 2 * o_custkey AS id, o_totalprice AS v, o_orderkey AS at_ FROM orders), last AS (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_ DESC, v DESC) AS rn FROM batch) WHERE rn = 1)
SELECT coalesce(c_custkey, id) AS id, CASE WHEN id IS NOT NULL THEN v ELSE c_acctbal END AS v, coalesce(c_name, 'new') AS first_seen FROM customer FULL JOIN last ON c_custkey = id""")
def upsert_latest_wins(s: Star) -> DataFrame:
    # Keys of the batch are doubled, so that some are known, some are new, and some customers get nothing.
    current = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("first_seen"))
    batch = s.table("orders").select((2 * F.col("o_custkey")).alias("id"), F.col("o_totalprice").alias("v"), F.lit("new").alias("first_seen"), F.col("o_orderkey").alias("at"))
    return upsert.latest_wins(current, batch, ["id"], [F.desc("at"), F.desc("v")], keep=("first_seen",))


@query("""WITH batch AS (SELECT 'company:' || lpad(CAST(s_suppkey + 40 AS VARCHAR), 8, '0') AS id, upper(s_name) AS label, s_nationkey < 10 AS has FROM supplier), old AS (SELECT 'company:' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, s_name AS label, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code FROM supplier)
SELECT coalesce(b.id, o.id) AS id, 'company' AS kind, coalesce(b.label, o.label) AS label, CASE WHEN b.has THEN 'new' ELSE o.code END AS code FROM old o FULL JOIN batch b ON o.id = b.id""")
def upsert_nodes(s: Star) -> DataFrame:
    nodes = s.nodes().filter("kind = 'company'")
    attrs = F.when(F.col("s_nationkey") < 10, F.create_map(F.lit("dart_code"), F.lit("new")))
    batch = s.table("supplier").select(
        ids.company_id(F.lpad((F.col("s_suppkey") + 40).cast("string"), 8, "0")).alias("id"), F.lit("company").alias("kind"),
        F.upper("s_name").alias("label"), attrs.alias("attrs")
    )
    return upsert.upsert_nodes(nodes, batch, [F.col("label")]).select("id", "kind", "label", F.col("attrs")["dart_code"].alias("code"))


@query(with_views("facts") + """, batch AS (SELECT company_id, CAST(CAST(bsns_year AS INT) + 3 AS VARCHAR) AS bsns_year, fiscal_period, fs_div, metric_key, 2 * amount AS amount FROM facts)
SELECT coalesce(f.company_id, b.company_id) AS company_id, coalesce(f.bsns_year, b.bsns_year) AS bsns_year, coalesce(f.fiscal_period, b.fiscal_period) AS fiscal_period, coalesce(f.fs_div, b.fs_div) AS fs_div, coalesce(f.metric_key, b.metric_key) AS metric_key,
  CAST(coalesce(b.amount, f.amount) AS DOUBLE) AS amount, CASE WHEN f.company_id IS NULL THEN 'batch' ELSE 'first' END AS source_ref
FROM facts f FULL JOIN batch b ON f.company_id = b.company_id AND f.bsns_year = b.bsns_year AND f.fiscal_period = b.fiscal_period AND f.fs_div = b.fs_div AND f.metric_key = b.metric_key""")
def upsert_facts(s: Star) -> DataFrame:
    facts = s.facts().withColumn("source_ref", F.lit("first"))
    batch = s.facts().withColumns({"bsns_year": (F.col("bsns_year").cast("int") + 3).cast("string"), "amount": 2 * F.col("amount"), "source_ref": F.lit("batch")})
    return double(upsert.upsert_facts(facts, batch, [F.col("amount")]), "amount")


@query(
    with_views("companies") + " SELECT company_id AS subject_id, 'IN_SECTOR' AS predicate, CASE WHEN nation < 5 THEN 'sector:new' ELSE 'sector:' || nation END AS object_id FROM companies"
)
def exclusive_edge(s: Star) -> DataFrame:
    old = s.sector_edges().select("subject_id", "predicate", "object_id")
    new = s.companies().filter("nation < 5").select(F.col("company_id").alias("subject_id"), F.lit("IN_SECTOR").alias("predicate"), F.lit("sector:new").alias("object_id"))
    return upsert.replace_exclusive(old, new, "IN_SECTOR")


def _customers(s: Star) -> DataFrame:
    """Customers whose names are often those of companies, in other legal forms."""
    spelt = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("(주) Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    return s.table("customer").select(ids.node_id("customer", s.code("c_custkey")).alias("id"), F.lit("customer").alias("kind"), spelt.alias("label"))


_MAPPED = """aliased AS (SELECT DISTINCT c_custkey % 150 AS spelt FROM customer WHERE c_acctbal < 500),
mapping AS (SELECT 'customer:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS old_id, 'company:' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS new_id
  FROM customer LEFT JOIN aliased ON c_custkey % 150 = spelt JOIN supplier ON CASE WHEN c_custkey % 2 = 1 THEN -1 WHEN spelt IS NOT NULL THEN 1 ELSE c_custkey % 150 END = s_suppkey)"""


def _customer_mapping(s: Star) -> DataFrame:
    company = s.companies().select(F.col("company_id").alias("id"), F.lit("company").alias("kind"), F.concat("label", F.lit(" Co., Ltd.")).alias("label"))
    nodes = company.unionByName(_customers(s))
    # A customer with a low balance gives its spelling as an alias of the first company.
    aliased = s.table("customer").filter("c_acctbal < 500").select(
        normalize.normalize_alias(F.concat(F.lit("(주) Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0"))).alias("alias_norm"),
        F.lit("company:00000001").alias("node_id")
    ).distinct()
    return upsert.customer_mapping(nodes, aliased, normalize.normalize_alias(F.col("label")), normalize.normalize_corp_name(F.col("label")))


@query(f"WITH {_MAPPED} SELECT * FROM mapping")
def resolve_customers(s: Star) -> DataFrame:
    return _customer_mapping(s)


def _sales(s: Star) -> DataFrame:
    rows = s.table("orders").select(
        F.concat(F.lit("company:"), s.code("o_custkey")).alias("subject_id"), F.lit("SELLS_TO").alias("predicate"),
        F.concat(F.lit("customer:"), s.code("o_custkey")).alias("object_id"), F.year("o_orderdate").cast("string").alias("period"),
        F.col("o_orderkey").alias("id")
    )
    return rows.groupBy("subject_id", "predicate", "object_id", "period").agg(F.min("id").alias("id"))


@query(f"""WITH {_MAPPED}, sales AS (SELECT 'company:' || lpad(CAST(o_custkey % 7 AS VARCHAR), 8, '0') AS subject_id, 'SELLS_TO' AS predicate, 'customer:' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS object_id, CAST(year(o_orderdate) AS VARCHAR) AS period, min(o_orderkey) AS id FROM orders GROUP BY ALL)
SELECT subject_id, predicate, object_id, period, id FROM (SELECT subject_id, predicate, coalesce(new_id, object_id) AS object_id, period, id, row_number() OVER (PARTITION BY subject_id, predicate, coalesce(new_id, object_id), period ORDER BY new_id IS NOT NULL, id) AS rn FROM sales LEFT JOIN mapping ON object_id = old_id) WHERE rn = 1""")
def repoint_customers(s: Star) -> DataFrame:
    sales = _sales(s).withColumn("subject_id", F.concat(F.lit("company:"), F.lpad((F.substring("subject_id", 9, 8).cast("long") % 7).cast("string"), 8, "0")))
    sales = sales.groupBy("subject_id", "predicate", "object_id", "period").agg(F.min("id").alias("id"))
    return upsert.repoint(sales, _customer_mapping(s), "object_id", [F.col("id")])


def _folding(s: Star) -> DataFrame:
    """Aliases that fold each brand into the first of its decade."""
    brand = s.table("part").select("p_brand").distinct()
    return brand.select(
        normalize.normalize_alias(F.col("p_brand")).alias("alias_norm"),
        F.concat(F.lit("segment:brand-"), F.expr("substr(p_brand, 7, 1)"), F.lit("1")).alias("node_id")
    )


@query(with_views("seg") + """, mapping AS (SELECT * FROM (SELECT DISTINCT object_id AS old_id, 'segment:brand-' || substr(object_id, 15, 1) || '1' AS new_id FROM seg) WHERE old_id <> new_id AND new_id IN (SELECT 'segment:' || replace(lower(p_brand), '#', '-') FROM part))
SELECT subject_id, predicate, object_id, period, share_pct FROM (SELECT subject_id, predicate, coalesce(new_id, object_id) AS object_id, period, share_pct, row_number() OVER (PARTITION BY subject_id, period, coalesce(new_id, object_id) ORDER BY new_id IS NOT NULL, share_pct DESC) AS rn FROM seg LEFT JOIN mapping ON object_id = old_id) WHERE rn = 1""")
def merge_segments(s: Star) -> DataFrame:
    mapping = upsert.alias_mapping(s.nodes(), _folding(s), "segment", normalize.normalize_alias(F.col("label")), "segment:")
    edges = s.segment_edges().select("subject_id", "predicate", "object_id", "period", F.col("qualifier.share_pct").alias("share_pct"))
    return upsert.repoint(edges, mapping, "object_id", [F.desc("share_pct")])


def _chains(s: Star) -> DataFrame:
    """old_id, new_id: of five brands each leads to the one before it, up to four steps; of the last five the first leads to the last, in a circle."""
    n = F.substring("p_brand", 7, 9).cast("int")
    before = F.when((n - 1) % 5 > 0, n - 1).when(n == 21, 25)
    name = lambda number: F.concat(F.lit("segment:brand-"), number.cast("string"))
    return s.table("part").select("p_brand").distinct().select(name(n).alias("old_id"), name(before).alias("new_id")).filter("new_id is not null")


@query(with_views("seg") + """, numbered AS (SELECT DISTINCT object_id AS old_id, CAST(substr(object_id, 15) AS INT) AS n FROM seg),
mapping AS (SELECT old_id, 'segment:brand-' || CAST((n - 1) // 5 * 5 + 1 AS INT) AS new_id FROM numbered WHERE n <= 20 AND (n - 1) % 5 > 0)
SELECT subject_id, predicate, object_id, period, share_pct FROM (SELECT subject_id, predicate, coalesce(new_id, object_id) AS object_id, period, share_pct, row_number() OVER (PARTITION BY subject_id, period, coalesce(new_id, object_id) ORDER BY new_id IS NOT NULL, share_pct DESC) AS rn FROM seg LEFT JOIN mapping ON object_id = old_id) WHERE rn = 1""")
def merge_segment_chains(s: Star) -> DataFrame:
    edges = s.segment_edges().select("subject_id", "predicate", "object_id", "period", F.col("qualifier.share_pct").alias("share_pct"))
    return upsert.repoint(edges, upsert.settled(_chains(s))[0], "object_id", [F.desc("share_pct")])


@query("SELECT DISTINCT 'segment:brand-' || substr(p_brand, 7) AS old_id, 'segment:brand-' || CASE WHEN p_brand = 'Brand#21' THEN 25 ELSE CAST(substr(p_brand, 7) AS INT) - 1 END AS new_id FROM part WHERE CAST(substr(p_brand, 7) AS INT) > 20")
def alias_cycles(s: Star) -> DataFrame:
    return upsert.settled(_chains(s))[1]


def _external(s: Star) -> tuple[DataFrame, DataFrame]:
    """Stakes among external companies, and a mapping of some of them to companies."""
    ext = lambda c: F.concat(F.lit("company:ext:"), (F.col(c) % 400).cast("string"))
    edges = s.table("orders").groupBy(
        ext("o_custkey").alias("subject_id"), ext("o_orderkey").alias("object_id"), F.year("o_orderdate").cast("string").alias("period")
    ).agg(F.min("o_orderkey").alias("id"))
    edges = edges.select("subject_id", F.lit("OWNS_STAKE_IN").alias("predicate"), "object_id", "period", "id")
    company = s.companies().select(F.col("company_id").alias("id"), F.lit("company").alias("kind"), "label")
    outside = s.spark.range(400).select(
        F.concat(F.lit("company:ext:"), F.col("id").cast("string")).alias("id"), F.lit("company").alias("kind"),
        F.concat(F.lit("Ext "), F.col("id").cast("string")).alias("label")
    )
    aliases = s.spark.range(400).filter("id % 5 = 0").select(
        F.concat(F.lit("ext "), F.col("id").cast("string")).alias("alias_norm"),
        F.concat(F.lit("company:"), F.lpad((F.col("id") % 90).cast("string"), 8, "0")).alias("node_id")
    )
    mapping = upsert.alias_mapping(company.unionByName(outside), aliases, "company", normalize.normalize_alias(F.col("label")), "company:", "company:ext:", "company:ext:")
    return edges, mapping


@query("""WITH edges AS (SELECT 'company:ext:' || o_custkey % 400 AS subject_id, 'OWNS_STAKE_IN' AS predicate, 'company:ext:' || o_orderkey % 400 AS object_id, CAST(year(o_orderdate) AS VARCHAR) AS period, min(o_orderkey) AS id FROM orders GROUP BY ALL),
mapping AS (SELECT 'company:ext:' || i AS old_id, 'company:' || lpad(CAST(i % 90 AS VARCHAR), 8, '0') AS new_id FROM range(0, 400, 5) t(i) WHERE i % 90 IN (SELECT s_suppkey FROM supplier)),
objects AS (SELECT subject_id, predicate, coalesce(new_id, object_id) AS object_id, period, id, row_number() OVER (PARTITION BY subject_id, coalesce(new_id, object_id), period ORDER BY new_id IS NOT NULL, id) AS rn FROM edges LEFT JOIN mapping ON object_id = old_id),
subjects AS (SELECT coalesce(new_id, subject_id) AS subject_id, predicate, object_id, period, id, row_number() OVER (PARTITION BY coalesce(new_id, subject_id), object_id, period ORDER BY new_id IS NOT NULL, id) AS rn FROM objects LEFT JOIN mapping ON subject_id = old_id WHERE objects.rn = 1)
SELECT subject_id, predicate, object_id, period, id FROM subjects WHERE rn = 1""")
def resolve_external_both_ends(s: Star) -> DataFrame:
    edges, mapping = _external(s)
    return upsert.repoint(upsert.repoint(edges, mapping, "object_id", [F.col("id")]), mapping, "subject_id", [F.col("id")])


@query("""WITH persons AS (SELECT 'person:' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0') || ':' || c_custkey AS id, 'owner ' || c_custkey % 50 AS label FROM customer)
SELECT id AS old_id, 'person:' || replace(label, ' ', '-') AS new_id FROM persons WHERE CAST(replace(label, 'owner ', '') AS INT) < 30""")
def merge_owners(s: Star) -> DataFrame:
    label = F.concat(F.lit("Owner "), (F.col("c_custkey") % 50).cast("string"))
    persons = s.table("customer").select(
        F.concat(F.lit("person:"), s.code("c_nationkey"), F.lit(":"), F.col("c_custkey").cast("string")).alias("id"), F.lit("person").alias("kind"),
        label.alias("label")
    )
    owners = s.spark.range(30).select(F.concat(F.lit("Owner "), F.col("id").cast("string")).alias("name"))
    canonical = owners.select(ids.canonical_person_id(F.col("name")).alias("id"), F.lit("owner").alias("kind"), F.col("name").alias("label"))
    aliases = owners.select(normalize.normalize_alias(F.col("name")).alias("alias_norm"), ids.canonical_person_id(F.col("name")).alias("node_id"))
    return upsert.alias_mapping(persons.unionByName(canonical), aliases, "person", normalize.normalize_alias(F.col("label")), "person:")


_SPLIT = "split_up AS (SELECT subject_id, predicate, CASE WHEN object_id = 'segment:brand-19' THEN object_id ELSE 'segment:' || right(subject_id, 8) || ':' || substr(object_id, 9) END AS object_id, object_id AS old_id, period, share_pct FROM seg)"


def _renamespaced(s: Star) -> tuple[DataFrame, DataFrame]:
    return upsert.renamespace(s.nodes(), s.segment_edges(), s.aliases(), [F.col("_old")])


@query(with_views("seg") + f", {_SPLIT} SELECT subject_id, predicate, object_id, period, share_pct FROM split_up")
def renamespace_segments(s: Star) -> DataFrame:
    return _renamespaced(s)[1].select("subject_id", "predicate", "object_id", "period", F.col("qualifier.share_pct").alias("share_pct"))


@query(with_views("seg", "companies") + f""", {_SPLIT}, brands AS (SELECT DISTINCT 'segment:' || replace(lower(p_brand), '#', '-') AS id, p_brand AS label FROM part)
SELECT company_id AS id, 'company' AS kind, label, NULL AS company FROM companies UNION ALL SELECT 'person:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 'person', c_name, NULL FROM customer
UNION ALL SELECT id, 'segment', label, NULL FROM brands WHERE id = 'segment:brand-19' OR id IN (SELECT object_id FROM split_up)
UNION ALL SELECT DISTINCT object_id, 'segment', label, right(subject_id, 8) FROM split_up JOIN brands ON id = old_id WHERE object_id <> old_id""")
def renamespace_nodes(s: Star) -> DataFrame:
    return _renamespaced(s)[0].select("id", "kind", "label", F.col("attrs")["company"].alias("company"))


@query(
    f"WITH {_MAPPED} SELECT 'customer:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, CASE WHEN 'customer:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') IN (SELECT old_id FROM mapping) THEN NULL ELSE 'false' END AS resolved FROM customer"
)
def mark_unresolved(s: Star) -> DataFrame:
    nodes = _customers(s).withColumn("attrs", F.lit(None).cast("map<string,string>"))
    return upsert.mark_unresolved(nodes, _customer_mapping(s)).select("id", F.col("attrs")["resolved"].alias("resolved"))


@query("SELECT DISTINCT 'person:owner-' || c_nationkey AS id, 'person' AS kind, 'Owner ' || c_nationkey AS label FROM customer")
def canonical_owners(s: Star) -> DataFrame:
    return upsert.canonical_owners(s.table("customer").select(F.concat(F.lit("Owner "), F.col("c_nationkey").cast("string")).alias("canonical"))).select("id", "kind", "label")


@query("""WITH seeds AS (SELECT p_partkey AS ordinal, CASE WHEN p_size % 5 = 0 THEN 'segment:none' ELSE 'segment:' || replace(lower(p_brand), '#', '-') END AS node_id, unnest([lower(p_type), lower(p_brand)]) AS alias_norm FROM part)
SELECT alias_norm, node_id FROM (SELECT *, row_number() OVER (PARTITION BY alias_norm ORDER BY ordinal DESC) AS rn FROM seeds WHERE node_id <> 'segment:none') WHERE rn = 1""")
def alias_seed(s: Star) -> DataFrame:
    target = F.when(F.col("p_size") % 5 == 0, "segment:none").otherwise(ids.segment_id(F.col("p_brand")))
    variants = F.array(normalize.normalize_alias(F.col("p_type")), normalize.normalize_alias(F.col("p_brand")))
    seeds = s.table("part").select(F.col("p_partkey").alias("ordinal"), target.alias("node_id"), variants.alias("variants"))
    return upsert.seed_aliases(s.nodes(), seeds, [F.desc("ordinal")])


# ---- scalar functions

@query(
    """SELECT p_partkey, 'segment:' || CASE WHEN length(b) <= 48 THEN b ELSE trim(left(b, 41), '-') || '-' || left(sha1(raw), 6) END AS slug FROM (SELECT p_partkey, raw, trim(regexp_replace(lower(trim(raw)), '[^0-9a-z가-힣]+', '-', 'g'), '-') AS b FROM (SELECT p_partkey, ' ' || p_name || ' (' || p_type || ') 반도체 & ' || repeat(p_brand || ' ', p_size % 4) AS raw FROM part))"""
)
def slug(s: Star) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_type", F.lit(") 반도체 & "), F.expr("repeat(concat(p_brand, ' '), p_size % 4)"))
    return s.table("part").select("p_partkey", ids.segment_id(raw).alias("slug"))


@query(
    "SELECT doc_id, length(alias) AS chars, md5(alias) AS digest FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS alias FROM documents)"
)
def normalize_alias(s: Star) -> DataFrame:
    alias = s.table("documents").select("doc_id", normalize.normalize_alias(F.col("text")).alias("alias"))
    return alias.select("doc_id", F.length("alias").cast("long").alias("chars"), F.md5(F.col("alias").cast("binary")).alias("digest"))


@query("SELECT c_custkey, replace(lower(c_name), ',', ' ') AS norm FROM customer")
def normalize_corp(s: Star) -> DataFrame:
    form = F.col("c_custkey") % 5
    named = F.when(form == 0, F.concat(F.lit("(주) "), "c_name")).when(form == 1, F.concat("c_name", F.lit(" Co., Ltd."))).when(form == 2, F.concat("c_name", F.lit(", Inc."))).when(
        form == 3, F.concat(F.lit("㈜"), "c_name", F.lit("  Corp"))
    ).otherwise(F.concat("c_name", F.lit(" Company")))
    return s.table("customer").select("c_custkey", normalize.normalize_corp_name(named).alias("norm"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 IN (0, 1, 3) THEN 'company' ELSE 'person' END AS kind FROM customer")
def classify_holder(s: Star) -> DataFrame:
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.concat("c_name", F.lit(" Inc."))).when(k == 1, "한국투자증권").otherwise(F.col("c_name"))
    relation = F.when(k == 2, "계열회사 임원").when(k == 3, "계열회사").when(k == 4, "본인").otherwise(F.lit(None))
    return s.table("customer").select("c_custkey", normalize.classify_shareholder(name, relation).alias("kind"))


@query(
    with_views("stake") + " SELECT holder_id, company_id, period, CASE WHEN stake_pct * 20 >= 50 THEN '자회사' WHEN stake_pct * 20 >= 20 THEN '관계회사' ELSE '기타' END AS affiliation FROM stake"
)
def affiliation(s: Star) -> DataFrame:
    return graph_query.stakes(s.stake_edges()).select("holder_id", "company_id", "period", normalize.affiliation(F.col("stake_pct") * 20).alias("affiliation"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN NULL WHEN o_orderkey % 10 = 2 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(22,2)) AS DOUBLE) END AS amount FROM orders"
)
def parse_amount(s: Star) -> DataFrame:
    k = F.col("o_orderkey") % 10
    raw = F.when(k == 0, "-").when(k == 1, " ").when(k == 2, "12d").otherwise(F.format_number(F.col("o_totalprice").cast("decimal(22,2)"), 2))
    return s.table("orders").select("o_orderkey", normalize.parse_amount(raw).cast("double").alias("amount"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) + CASE WHEN p_size % 4 = 1 THEN 0.5 ELSE 0 END END AS share FROM part")
def coerce_share(s: Star) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    raw = F.when(k == 0, F.concat(F.lit("약 "), size, F.lit("%"))).when(k == 1, F.concat(size, F.lit(".5 %"))).when(k == 2, F.concat(F.lit("-"), size)).otherwise("n/a")
    return s.table("part").select("p_partkey", normalize.coerce_share(raw).alias("share"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS block FROM events")
def json_block(s: Star) -> DataFrame:
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise("no braces here")
    return s.table("events").select("event_id", normalize.json_block(said).alias("block"))


@query(with_views("facts") + f" SELECT DISTINCT bsns_year || fiscal_period AS label, {_KEY} AS key FROM facts")
def period_key(s: Star) -> DataFrame:
    labels = s.facts().select(F.concat("bsns_year", "fiscal_period").alias("label")).distinct()
    return labels.select("label", ids.label_key(F.col("label")).alias("key"))


_WIDE = "wide AS (SELECT company_id, bsns_year, fiscal_period, max(CASE WHEN metric_key = 'revenue' THEN amount END) AS revenue, max(CASE WHEN metric_key = 'operating_income' THEN amount END) AS operating_income FROM pref GROUP BY ALL)"


@query(
    with_views("facts") + f", {_PREFERRED}, {_WIDE} SELECT company_id, bsns_year, fiscal_period, CAST(revenue AS DOUBLE) AS revenue, CAST(operating_income AS DOUBLE) AS operating_income FROM wide"
)
def fin_pivot(s: Star) -> DataFrame:
    return double(projection.financial_pivot(s.facts(), ["revenue", "operating_income"]), "revenue", "operating_income")


@query(
    with_views("facts") + f", {_PREFERRED}, {_WIDE} SELECT company_id, bsns_year, fiscal_period, round(100 * CAST(operating_income AS DOUBLE) / CAST(revenue AS DOUBLE), 6) AS opm, CASE WHEN operating_income <> 0 THEN round(100 * CAST(revenue AS DOUBLE) / CAST(operating_income AS DOUBLE), 6) END AS debt_ratio FROM wide"
)
def fin_ratios(s: Star) -> DataFrame:
    wide = projection.financial_pivot(s.facts(), ["revenue", "operating_income"]).withColumns(
        {"liabilities": F.col("revenue"), "equity": F.col("operating_income"), "net_income": F.col("revenue")}
    )
    out = projection.financial_ratios(wide)
    return out.select("company_id", "bsns_year", "fiscal_period", F.round("opm", 6).alias("opm"), F.round("debt_ratio", 6).alias("debt_ratio"))


# ---- text

# The plain pages have no tables: one with markup in its cells, an empty row and character references is put behind each.
_TABLE = "<p>a &lt;&#44277;&amp;&#xAC00;</p><table border=1><tr><td> {0} </td><th><b>x</b> y&amp;z</th></tr><tr><td> </td></tr><TR><td>&nbsp;</td><td>two<br> words</td></TR></table> after"


_PLAIN_PAGES = r"""WITH plain AS (SELECT page_id, list_concat(list_filter(flatten(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<[^>]*>'), lambda x: string_split_regex(trim(replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), chr(32) || chr(9) || chr(10) || chr(13)), '\r?\n'))), lambda x: trim(x, chr(32) || chr(9)) <> ''), {tail}) AS lines FROM pages)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, md5(array_to_string(lines, chr(10))) AS digest FROM plain"""


@query(_PLAIN_PAGES.replace("{tail}", "['a <공&가', page_id || chr(9) || 'xy&z', chr(9) || 'twowords', 'after']"))
def html_lines(s: Star) -> DataFrame:
    before, after = _TABLE.split("{0}")
    lines = text.html_lines(F.concat("html", F.lit(before), F.col("page_id").cast("string"), F.lit(after)))
    return s.table("pages").select("page_id", lines.alias("lines")).select(
        "page_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest")
    )


# A table in a table's cell, cells and rows that are not closed, a stray sign, a comment and a script inside a text.
_NESTED = "<table><tr><td>o{0}<table><tr><td>i1<td> i2 </table> p</td><td>q</td></tr><tr><th>u<th>v<tr><td></td></table>x<!-- c -->y<script>z</script> 1 < 2 &amp; 3"


@query(_PLAIN_PAGES.replace("{tail}", "['o' || page_id || 'i1i2p' || chr(9) || 'i1' || chr(9) || 'i2' || chr(9) || 'q', 'i1' || chr(9) || 'i2', 'u' || chr(9) || 'v', 'x', 'y', '1 < 2 & 3']"))
def page_lines(s: Star) -> DataFrame:
    before, after = _NESTED.split("{0}")
    rows = pages.page_lines(s.table("pages").select("page_id", F.concat("html", F.lit(before), F.col("page_id").cast("string"), F.lit(after)).alias("html")), "html")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return rows.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(ordered, "\n").cast("binary")).alias("digest"))


_TITLES = ("사업의 개요", "주요 제품 등", "매출 및 수주", "기타")


def _filings(s: Star) -> DataFrame:
    """doc and lines: conversations as filings, each turn under a numbered header."""
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("turn") % 4).cast("int"))
    head = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), title)
    part = F.struct("turn", F.concat(head, F.lit("\n"), F.regexp_replace("text", "\n", " ")).alias("body"))
    return s.table("conversations").groupBy(F.col("conv_id").alias("doc")).agg(
        F.split(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["body"]), "\n"), "\n").alias("lines")
    )


_FILED = "filed AS (SELECT conv_id AS doc, turn, (['사업의 개요', '주요 제품 등', '매출 및 수주', '기타'])[turn % 4 + 1] AS title, replace(text, chr(10), ' ') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE turn < 9)"


@query(f"WITH {_FILED} SELECT doc, CAST(2 * (place - 1) AS INT) AS line_no, title FROM filed")
def header_detect(s: Star) -> DataFrame:
    rows = sections.numbered_lines(_filings(s), "doc", F.col("lines"))
    return sections.headers(rows).select("doc", "line_no", "title")


@query(f"WITH {_FILED} SELECT doc, CAST(2 * (place - 1) AS INT) AS line_no, title, body, CAST(length(body) AS INT) AS chars FROM filed")
def section_bodies(s: Star) -> DataFrame:
    rows = sections.numbered_lines(_filings(s), "doc", F.col("lines"))
    return sections.bodies(rows, sections.headers(rows))


@query(f"""WITH {_FILED}, firsts AS (SELECT doc, turn % 4 AS t, body FROM (SELECT *, row_number() OVER (PARTITION BY doc, turn % 4 ORDER BY turn) AS rn FROM filed WHERE turn % 4 < 3) WHERE rn = 1),
got AS (SELECT doc, count(*) AS n, count(*) FILTER (length(body) < 100) AS short FROM firsts GROUP BY doc)
SELECT DISTINCT doc, CASE WHEN short > 0 THEN 'full_text' ELSE 'regex' END AS level, CAST(3 - n AS INT) AS n_skipped, CAST(short AS INT) AS n_invalid FROM got""")
def escalation_level(s: Star) -> DataFrame:
    out = sections.sections(_filings(s), "doc", F.col("lines"), least=100)
    return out.select("doc", "level", F.size("skipped").alias("n_skipped"), F.size("invalid").alias("n_invalid"))


def _observed(s: Star) -> DataFrame:
    return s.table("events").select(
        F.get(F.array(*map(F.lit, sections.TARGETS)), (F.col("user_id") % 3).cast("int")).alias("target"),
        F.concat(F.lit("re"), (F.col("user_id") % 40).cast("string")).alias("regex"), F.col("event_type").alias("header"),
        F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("refuted"), F.array(F.col("event_type")).alias("samples"),
        F.lit(1).alias("confirmed_count"), F.when(F.col("event_id") % 2 == 0, "learned").otherwise("code_baseline").alias("source"),
        F.col("event_id").alias("ordinal")
    )


_OBSERVED = "observed AS (SELECT (['overview', 'products', 'revenue'])[user_id % 3 + 1] AS target, 're' || user_id % 40 AS regex, event_type AS header, event_id AS at_, event_type = 'error' AS refuted, CASE WHEN event_id % 2 = 0 THEN 'learned' ELSE 'code_baseline' END AS source FROM events)"


@query(
    f"WITH {_OBSERVED} SELECT target, regex, array_to_string(list_sort(list_distinct(list(header))), ',') AS samples, count(*) AS confirmed_count, arg_min(source, at_) AS source FROM observed GROUP BY target, regex"
)
def pattern_consolidate(s: Star) -> DataFrame:
    return sections.consolidate_patterns(_observed(s)).withColumn("samples", F.array_join("samples", ","))


@query(
    f"WITH {_OBSERVED} SELECT target, regex, count(*) AS seen, array_to_string(list_sort(list_distinct(list(header))), ',') AS headers, min(at_) AS first_seen, max(at_) AS last_seen, bool_or(refuted) AS refuted, count(*) >= 3 AND NOT bool_or(refuted) AS promoted FROM observed GROUP BY target, regex"
)
def proposal_promote(s: Star) -> DataFrame:
    return sections.promote_proposals(_observed(s)).withColumn("headers", F.array_join("headers", ","))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '주요.{0,3}제품' WHEN 1 THEN '매출.{0,3}수주상황' ELSE NULL END AS pattern FROM customer")
def keyword_pattern(s: Star) -> DataFrame:
    k = F.col("c_custkey") % 3
    header = F.when(k == 0, "(제조서비스업) 주요 제품 등").when(k == 1, "Ⅱ. 매출 및 수주상황").otherwise("등 및")
    return s.table("customer").select("c_custkey", text.keyword_pattern(F.regexp_replace(header, r"Ⅱ\.", "Ⅱ")).alias("pattern"))


# Patterns as they are learned: plain, with escapes and gaps, with alternatives (no literal), not compiling, optional characters and an anchor.
_LEARNED = """pats AS (SELECT DISTINCT (['overview', 'products', 'revenue'])[p_partkey % 3 + 1] AS target, CASE p_size % 5 WHEN 0 THEN replace(p_name, ' ', '.{0,3}') || '.{0,9}' || p_type
  WHEN 1 THEN p_type || ' ' || replace(p_brand, '#', '\\#') WHEN 2 THEN replace(p_name, ' ', '|') WHEN 3 THEN p_type || '(' ELSE 'x?' || p_brand || '$' END AS regex FROM part),
heads AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS header FROM part)"""


def _learned(s: Star) -> DataFrame:
    k, gap = F.col("p_size") % 5, F.lit(".{0,3}")
    regex = F.when(k == 0, F.concat(F.replace("p_name", F.lit(" "), gap), F.lit(".{0,9}"), "p_type")).when(
        k == 1, F.concat("p_type", F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("\\#")))
    ).when(k == 2, F.replace("p_name", F.lit(" "), F.lit("|"))).when(k == 3, F.concat("p_type", F.lit("("))).otherwise(F.concat(F.lit("x?"), "p_brand", F.lit("$")))
    target = F.get(F.array(*map(F.lit, sections.TARGETS)), (F.col("p_partkey") % 3).cast("int"))
    return s.table("part").select(target.alias("target"), regex.alias("regex"), "p_partkey", "p_type")


def _headers(s: Star) -> DataFrame:
    return s.table("part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("header"), "p_partkey")


@query(f"WITH {_LEARNED} SELECT header, target, regex FROM (SELECT * FROM pats WHERE regex NOT LIKE '%(') JOIN heads ON regexp_matches(header, regex)")
def pattern_matches(s: Star) -> DataFrame:
    return patterns.matches(_learned(s), _headers(s))


@query(f"WITH {_LEARNED} SELECT target, regex, 'no regular expression' AS problem FROM pats WHERE regex LIKE '%('")
def pattern_rejects(s: Star) -> DataFrame:
    return patterns.rejects(_learned(s))


_STORED = f"""{_LEARNED}, seen AS (SELECT (['overview', 'products', 'revenue'])[p_partkey % 3 + 1] AS target, CASE p_size % 5 WHEN 0 THEN replace(p_name, ' ', '.{{0,3}}') || '.{{0,9}}' || p_type
  WHEN 1 THEN p_type || ' ' || replace(p_brand, '#', '\\#') WHEN 2 THEN replace(p_name, ' ', '|') WHEN 3 THEN p_type || '(' ELSE 'x?' || p_brand || '$' END AS regex, p_type AS header, p_partkey AS at_ FROM part),
store AS (SELECT target, regex, 2 * count(*) AS seen, array_to_string(list_sort(list_distinct(list(header))), ',') AS headers, min(at_) AS first_seen, max(at_) AS last_seen FROM seen GROUP BY ALL)"""


def _store(s: Star) -> DataFrame:
    """A store that has taken in the same observations twice."""
    observed = _learned(s).select("target", "regex", F.col("p_type").alias("header"), F.lit("part").alias("source"), F.col("p_partkey").alias("at"))
    none = s.spark.createDataFrame([], "target string, regex string, seen long, headers array<string>, sources array<string>, first_seen long, last_seen long")
    return patterns.record_proposals(patterns.record_proposals(none, observed), observed)


@query(f"WITH {_STORED} SELECT *, 'part' AS sources FROM store")
def proposal_store(s: Star) -> DataFrame:
    return _store(s).withColumns({"headers": F.array_join("headers", ","), "sources": F.array_join("sources", ",")})


@query(f"""WITH {_STORED}, fixtures AS (SELECT DISTINCT (['overview', 'products', 'revenue'])[length(p_type) % 3 + 1] AS other, p_name || ' ' || p_type || ' ' || p_brand AS header FROM part),
hits AS (SELECT target, regex, min(other) AS hit FROM store JOIN fixtures ON other <> target AND regexp_matches(header, regex) WHERE seen >= 6 AND regex NOT LIKE '%(' GROUP BY ALL)
SELECT target, regex, seen, seen >= 6 AND hit IS NULL AND regex NOT LIKE '%(' AS promoted,
  CASE WHEN seen < 6 THEN NULL WHEN regex LIKE '%(' THEN '__invalid:no regular expression' ELSE '__rejected_by:' || hit END AS tag FROM store LEFT JOIN hits USING (target, regex)""")
def proposal_judge(s: Star) -> DataFrame:
    target = F.get(F.array(*map(F.lit, sections.TARGETS)), F.length("p_type") % 3)
    fixtures = s.table("part").select(target.alias("target"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("header"))
    return patterns.judged_proposals(_store(s), fixtures, least=6).select("target", "regex", "seen", "promoted", "tag")


# ---- operations

@query(with_views("queue") + " SELECT id, corp_code FROM queue WHERE status = 'pending' ORDER BY id LIMIT 50")
def queue_next(s: Star) -> DataFrame:
    return operations.queue_next(s.queue(), 80, 50).select("id", "corp_code")


_OUTCOME = "CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'extract_error' ELSE 'fetch_error' END"


@query(
    with_views("queue") + f" SELECT id, attempts + 1 AS attempts, CASE WHEN id % 4 = 0 THEN 'done' WHEN id % 4 = 1 THEN 'failed' WHEN id % 4 = 3 THEN 'skipped' WHEN attempts + 1 < 3 THEN 'pending' ELSE 'failed' END AS status FROM queue WHERE {_OUTCOME} IS NOT NULL"
)
def queue_transition(s: Star) -> DataFrame:
    k = F.col("id") % 4
    outcome = F.when(k == 0, "ok").when(k == 1, "extract_error").otherwise("fetch_error")
    status, attempts = operations.transition(F.col("attempts"), outcome, F.when(k == 3, "no report found").otherwise("timeout"))
    return s.queue().select("id", attempts.alias("attempts"), status.alias("status"))


@query(
    with_views("queue") + " SELECT id, CASE WHEN status = 'in_progress' AND last_attempt_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 180 MINUTES THEN 'pending' ELSE status END AS status FROM queue"
)
def stale_reset(s: Star) -> DataFrame:
    return operations.reset_stale(s.queue(), F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")).select("id", "status")


@query(
    "SELECT event_id, day, used FROM (SELECT event_id, CAST(ts + INTERVAL 9 HOURS AS DATE) AS day, CAST(sum(event_id % 3 + 1) OVER (PARTITION BY CAST(ts + INTERVAL 9 HOURS AS DATE) ORDER BY ts, event_id) AS BIGINT) AS used FROM events) WHERE used <= 100"
)
def daily_budget(s: Star) -> DataFrame:
    calls = s.table("events").select("event_id", "ts", (F.col("event_id") % 3 + 1).alias("cost"))
    return operations.within_budget(calls, "ts", [F.col("ts"), F.col("event_id")], "cost", 100).select("event_id", "day", "used")


@query(
    with_views("listed") + " SELECT corp_code, rcept_no, substr(report_nm, 16, 4) AS period FROM listed WHERE report_nm LIKE 'annual%' AND rcept_dt >= '19960101' AND corp_code IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer WHERE c_mktsegment <> 'BUILDING')"
)
def incremental_new(s: Star) -> DataFrame:
    listed = s.listed()
    known = listed.filter("rcept_dt < '19960101'").select("rcept_no")
    members = s.table("customer").filter("c_mktsegment <> 'BUILDING'").select(s.code("c_custkey").alias("corp_code"))
    return operations.new_reports(listed, members, known, "annual").select("corp_code", "rcept_no", "period")


@query("""WITH had AS (SELECT p_partkey AS ticker, p_size % 7 = 0 AS gone FROM part), today AS (SELECT p_partkey + 70 AS ticker, p_size FROM part)
SELECT coalesce(h.ticker, t.ticker) AS ticker, CASE WHEN t.ticker IS NULL THEN 'delisted' WHEN t.p_size = 11 THEN 'unlinked' WHEN h.ticker IS NULL THEN 'added' WHEN gone THEN 'relisted' ELSE 'updated' END AS change FROM had h FULL JOIN today t ON h.ticker = t.ticker WHERE t.ticker IS NOT NULL OR NOT gone""")
def lifecycle_diff(s: Star) -> DataFrame:
    # Today's tickers are those on record, moved on by 70: some are gone, some are new.
    part = s.table("part").select(F.col("p_partkey").alias("ticker"), "p_size")
    had = part.select("ticker", F.when(F.col("p_size") % 7 == 0, F.lit("2024-01-01")).cast("date").alias("delisted_at"))
    moved = part.withColumn("ticker", F.col("ticker") + 70)
    today = operations.listing(moved.filter("p_size < 30"), moved.filter("p_size > 20"))
    return operations.lifecycle(had, today, moved.filter("p_size <> 11"))


@query(
    with_views("companies", "queue") + " SELECT dart_code AS corp_code, y AS period FROM companies JOIN (SELECT unnest(['2022', '2023', '2024']) AS y) ON true WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.corp_code = dart_code AND q.period = y)"
)
def enrol_targets(s: Star) -> DataFrame:
    return operations.enrol(s.companies().select(F.col("dart_code").alias("corp_code")), ["2022", "2023", "2024"], s.queue())


@query(with_views("queue") + " SELECT status, count(*) AS n, CAST(sum(cost_estimate_usd) AS DOUBLE) AS cost FROM queue GROUP BY status")
def status_counts(s: Star) -> DataFrame:
    return double(operations.status_counts(s.queue()), "cost")


@query(with_views("queue") + " SELECT id, CAST(cost_estimate_usd AS DOUBLE) AS cost FROM queue ORDER BY cost_estimate_usd DESC, id LIMIT 10")
def top_cost(s: Star) -> DataFrame:
    return operations.top_cost(s.queue()).select("id", F.col("cost_estimate_usd").cast("double").alias("cost"))


@query(
    "SELECT l_suppkey, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT year(l_shipdate)), [2024, 2025, 2026]))), ',') AS years FROM lineitem GROUP BY l_suppkey"
)
def years_union_floor(s: Star) -> DataFrame:
    rows = s.table("lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"))
    return operations.years_with_floor(rows, "l_suppkey", 2026, 3).select("l_suppkey", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


_FILED_LATER = "later AS (SELECT corp_code, report_nm, rcept_no, strftime(strptime(rcept_dt, '%Y%m%d') + INTERVAL 9 MONTH, '%Y%m%d') AS rcept_dt FROM listed)"


@query(
    with_views("listed") + f", {_FILED_LATER} SELECT corp_code, substr(report_nm, 16, 4) AS period, arg_max(rcept_no, rcept_dt || rcept_no) AS rcept_no FROM later WHERE report_nm LIKE 'annual%' AND CAST(substr(rcept_dt, 1, 4) AS INT) = CAST(substr(report_nm, 16, 4) AS INT) + 1 AND substr(rcept_dt, 5) <= '0701' GROUP BY ALL"
)
def latest_report(s: Star) -> DataFrame:
    filed = F.add_months(F.to_date("rcept_dt", "yyyyMMdd"), 9)
    return operations.latest_report(s.listed().withColumn("rcept_dt", F.date_format(filed, "yyyyMMdd")), "annual")


@query(
    with_views("companies", "queue") + " SELECT count(*) FILTER (q IS NULL) AS added, count(q) AS skipped, 2 * count(*) FILTER (q IS NULL) AS calls, 0.25 * count(*) FILTER (q IS NULL) AS cost FROM (SELECT dart_code, y FROM companies, (SELECT unnest(['2023', '2024']) AS y)) LEFT JOIN (SELECT DISTINCT corp_code, period, 1 AS q FROM queue) ON corp_code = dart_code AND period = y"
)
def enrol_estimate(s: Star) -> DataFrame:
    return operations.enrol_estimate(s.companies().select(F.col("dart_code").alias("corp_code")), ["2023", "2024"], s.queue())


@query(
    "SELECT event_id, CASE event_type WHEN 'view' THEN DATE '2024-02-01' WHEN 'click' THEN DATE '2024-01-31' WHEN 'error' THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events"
)
def relative_date(s: Star) -> DataFrame:
    kind = F.col("event_type")
    spec = F.when(kind == "view", "today").when(kind == "click", " Yesterday").when(kind == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return s.table("events").select("event_id", operations.relative_date(spec, F.lit("2024-02-01").cast("date")).alias("day"))


@query(
    with_views("facts") + " SELECT DISTINCT 'metric:' || metric_key AS id, 'metric' AS kind, CASE metric_key WHEN 'revenue' THEN '매출액' ELSE '영업이익' END AS label FROM facts UNION SELECT 'period:' || bsns_year || fiscal_period, 'period', bsns_year || ' ' || fiscal_period FROM facts"
)
def fact_nodes(s: Star) -> DataFrame:
    return ingest.fact_nodes(s.facts())


@query(
    "SELECT DISTINCT 'company:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, 'company' AS kind, coalesce(p_name, lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS label, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code FROM customer LEFT JOIN part ON p_partkey = c_custkey AND p_size > 20 WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"
)
def missing_companies(s: Star) -> DataFrame:
    master = s.table("part").select(s.code("p_partkey").alias("corp_code"), F.when(F.col("p_size") > 20, F.col("p_name")).otherwise(" ").alias("corp_name"))
    found = ingest.missing_companies(s.table("customer").select(s.code("c_custkey").alias("corp_code")), s.nodes(), master)
    return found.select("id", "kind", "label", F.col("attrs")["dart_code"].alias("code"))


@query(f"WITH {_OBSERVED} SELECT target, source, count(*) AS n FROM observed GROUP BY ALL")
def pattern_stats(s: Star) -> DataFrame:
    return sections.pattern_stats(_observed(s))


@query(with_views("seg") + " SELECT DISTINCT subject_id AS company_id, period AS year FROM seg WHERE share_pct >= 4")
def fiscal_years(s: Star) -> DataFrame:
    half = s.segment_edges().withColumn("period", F.when(F.col("qualifier.share_pct") < 4, F.concat("period", F.lit("H1"))).otherwise(F.col("period")))
    return graph_query.fiscal_years(half)


@query(
    with_views("seg", "companies") + """ SELECT corp_code, bsns_year, reprt_code FROM (SELECT DISTINCT right(subject_id, 8) AS corp_code, period AS bsns_year FROM seg UNION SELECT dart_code, y FROM companies, (SELECT unnest(['1998', '1999', '2000']) AS y)) , (SELECT unnest(['11011', '11013']) AS reprt_code)"""
)
def report_targets(s: Star) -> DataFrame:
    companies = s.companies().select("company_id", F.col("dart_code").alias("corp_code"))
    return operations.report_targets(companies, graph_query.fiscal_years(s.segment_edges()), ("11011", "11013"), 2000, 3)


@query(
    "SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ticker, lpad(CAST(min(c_custkey) AS VARCHAR), 8, '0') AS corp_code, min(c_custkey) IS NOT NULL AS found FROM part LEFT JOIN (SELECT * FROM customer WHERE c_nationkey > 3) ON c_custkey // 2 = p_partkey GROUP BY p_partkey"
)
def ticker_codes(s: Star) -> DataFrame:
    # Keys meet at their full length: padding cuts longer ones, so it comes last.
    stock = F.when(F.col("c_nationkey") > 3, F.floor(F.col("c_custkey") / 2).cast("string")).otherwise(" ")
    master = s.table("customer").select(F.lpad(F.col("c_custkey").cast("string"), 20, "0").alias("corp_code"), stock.alias("stock_code"))
    found = operations.ticker_codes(s.table("part").select(F.col("p_partkey").cast("string").alias("ticker")), master)
    return found.withColumns({"ticker": F.lpad("ticker", 6, "0"), "corp_code": F.lpad(F.col("corp_code").cast("long").cast("string"), 8, "0")})


_BATCH = """ready AS (SELECT * REPLACE (CASE WHEN status = 'in_progress' AND last_attempt_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 180 MINUTES THEN 'pending' ELSE status END AS status) FROM queue),
batch AS (SELECT id FROM ready WHERE status = 'pending' ORDER BY id LIMIT 300),
after AS (SELECT r.id, CASE WHEN b.id IS NULL OR r.id % 5 = 4 THEN attempts ELSE attempts + 1 END AS attempts, b.id IS NOT NULL AS picked, b.id IS NOT NULL AND r.id % 5 < 4 AS processed,
  CASE WHEN b.id IS NULL OR r.id % 5 = 4 THEN status WHEN r.id % 5 = 0 THEN 'done' WHEN r.id % 5 = 1 THEN 'failed' WHEN r.id % 5 = 3 THEN 'skipped' WHEN attempts + 1 < 3 THEN 'pending' ELSE 'failed' END AS status FROM ready r LEFT JOIN batch b ON r.id = b.id)"""


def _after_batch(s: Star) -> DataFrame:
    k = F.col("event_id") % 5
    outcome = F.when(k == 0, "ok").when(k == 1, "extract_error").when(k < 4, "fetch_error")
    outcomes = s.table("events").select(
        F.col("event_id").alias("id"), outcome.alias("outcome"), F.when(k == 3, "no report found").otherwise("timeout").alias("message"),
        F.lit("regex").alias("level"), F.lit(1000).alias("chars")
    ).filter("outcome is not null")
    queue = s.queue().withColumns({"last_error": F.lit(None).cast("string"), "escalation_level": F.lit(None).cast("string")})
    return operations.run_batch(queue, outcomes, F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'"), 300)


@query(with_views("queue") + f", {_BATCH} SELECT id, attempts, status, picked, processed FROM after")
def run_batch(s: Star) -> DataFrame:
    return _after_batch(s).select("id", "attempts", "status", "picked", "processed")


@query(
    with_views("queue") + f", {_BATCH} SELECT count(*) FILTER (processed) AS processed, count(*) FILTER (processed AND status = 'done') AS done, count(*) FILTER (processed AND status = 'skipped') AS skipped, count(*) FILTER (processed AND status = 'failed') AS failed, count(*) FILTER (picked AND NOT processed) AS rate_limit_hits, count(*) FILTER (status = 'pending') AS pending_remaining, 300 - count(*) FILTER (processed) AS budget_remaining FROM after"
)
def batch_summary(s: Star) -> DataFrame:
    return operations.batch_summary(_after_batch(s), 300)


@query(
    "SELECT CASE WHEN user_id % 4 = 0 THEN 'full_text' WHEN user_id % 4 = 1 THEN NULL ELSE 'regex' END AS escalation_level, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL"
)
def escalation_counts(s: Star) -> DataFrame:
    level = F.when(F.col("corp_code").cast("int") % 4 == 1, F.lit(None)).when(F.col("corp_code").cast("int") % 4 >= 2, "regex").otherwise("full_text")
    return operations.escalation_counts(s.queue().withColumn("escalation_level", level))


@query(
    "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS) AS created, count(*) FILTER (event_type = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-13') AS delisted FROM events"
)
def recent_changes(s: Star) -> DataFrame:
    stocks = s.table("events").select(F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", F.to_date("ts")).alias("delisted_at"))
    return operations.recent_changes(stocks, F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def random_sample(s: Star) -> DataFrame:
    return operations.sample(s.table("orders"), "o_orderkey", 100, 7).select("o_orderkey")


@query("SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_nationkey > 3")
def universe_of_stocks(s: Star) -> DataFrame:
    rows = s.table("orders").join(s.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    gone = F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))
    return operations.universe_of_stocks(rows.select(F.when(F.col("c_nationkey") > 3, s.code("c_custkey")).alias("corp_code"), gone.alias("delisted_at")))


# ---- projections

@query(with_views("seg", "facts") + """ SELECT subject_id, predicate, object_id, period, share_pct, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS fs_div, CAST(NULL AS VARCHAR) AS period_node, 'llm' AS source_type, 0.5 AS confidence FROM seg
UNION ALL SELECT company_id, 'REPORTS', 'metric:' || metric_key, bsns_year || fiscal_period, NULL, CAST(CAST(amount AS DECIMAL(22,2)) AS DOUBLE), fs_div, 'period:' || bsns_year || fiscal_period, 'dart_api', 1.0 FROM facts""")
def graph_export(s: Star) -> DataFrame:
    edges = s.segment_edges().withColumns({"source_type": F.lit("llm"), "confidence": F.lit(0.5)})
    facts = s.facts().withColumns({"amount": F.col("amount").cast("decimal(22,2)"), "source_type": F.lit("dart_api"), "confidence": F.lit(1.0)})
    return projection.graph_union(edges, facts).select(
        "subject_id", "predicate", "object_id", "period", F.col("qualifier.share_pct").alias("share_pct"), "reported.amount", "reported.fs_div",
        "reported.period_node", "source_type", "confidence"
    )


_SHORT = "short AS (SELECT subject_id, predicate, object_id, period, floor(share_pct * 100) / 100 AS share FROM seg)"


def _short_shares(s: Star) -> DataFrame:
    """Segment edges with shares of two places, which both engines print alike."""
    return s.segment_edges().withColumn("qualifier", F.col("qualifier").withField("share_pct", F.floor(F.col("qualifier.share_pct") * 100) / 100))


@query(
    with_views("seg") + f", {_SHORT} SELECT object_id, array_to_string(list_sort(list_distinct(list(predicate || ' ' || subject_id || ' ' || format('{{:g}}', share)))), '|') AS referrers, count(DISTINCT (subject_id, share)) AS n FROM short GROUP BY object_id"
)
def backlinks(s: Star) -> DataFrame:
    return projection.backlinks(_short_shares(s))


@query(
    with_views("stake") + f", {_OWNED} SELECT holder_id, array_to_string(list_sort(list(DISTINCT company_id)), ',') AS companies, count(DISTINCT company_id) AS n FROM owned GROUP BY holder_id"
)
def person_holdings(s: Star) -> DataFrame:
    return projection.person_holdings(s.stake_edges(), s.shuffles())


@query(
    with_views("companies", "facts") + " SELECT company_id, label, coalesce(n_name, '—') AS sector, coalesce(years, '—') AS years FROM companies LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = nation LEFT JOIN (SELECT company_id, array_to_string(list_sort(list(DISTINCT bsns_year)), ',') AS years FROM facts WHERE fs_div = 'CFS' GROUP BY company_id) USING (company_id)"
)
def company_index(s: Star) -> DataFrame:
    names = s.table("nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("sector"))
    sectors = s.companies().join(names, "nation").select("company_id", "sector")
    return projection.company_index(s.nodes(), sectors, s.facts().filter("fs_div = 'CFS'"))


_CARD = """card AS (SELECT company_id, label, coalesce(segments, 0) AS segments, coalesce(holders, 0) AS holders, coalesce(periods, 0) AS periods, coalesce(issues, 0) AS issues FROM companies
  LEFT JOIN (SELECT subject_id AS company_id, count(*) AS segments FROM seg GROUP BY ALL) USING (company_id)
  LEFT JOIN (SELECT company_id, count(DISTINCT holder_id) AS holders FROM stake GROUP BY ALL) USING (company_id)
  LEFT JOIN (SELECT company_id, count(DISTINCT bsns_year || fiscal_period) AS periods FROM facts GROUP BY ALL) USING (company_id)
  LEFT JOIN (SELECT company_id, count(*) AS issues FROM facts WHERE metric_key = 'operating_income' AND amount <= 0 GROUP BY ALL) USING (company_id))"""


def _cards(s: Star) -> DataFrame:
    issues = integrity.nonpositive_equity(s.facts(), "operating_income").withColumnRenamed("company_id", "subject")
    return projection.company_card(s.nodes(), union(s.segment_edges(), s.stake_edges()), s.facts(), issues, s.shuffles())


@query(with_views("companies", "seg", "stake", "facts") + f", {_CARD} SELECT * FROM card")
def company_card(s: Star) -> DataFrame:
    return _cards(s)


_EOK = "format('{{:,.0f}}', CAST({} AS DOUBLE) / 1e8) || '억'"
_TABLES = f"""{_PREFERRED}, {_WIDE}, keyed AS (SELECT *, {_KEY} AS key FROM wide),
tables AS (SELECT company_id, list(bsns_year || fiscal_period ORDER BY key) AS periods, chr(10) || '## 재무 (연결 우선, 단위 억원)' || chr(10) || chr(10) || '| 지표 | ' || string_agg(bsns_year || ' ' || fiscal_period, ' | ' ORDER BY key) || ' |' || chr(10) || '|------|' || repeat('------|', count(*)) || chr(10)
  || '| 매출액 | ' || string_agg({_EOK.format("revenue")}, ' | ' ORDER BY key) || ' |' || chr(10) || '| 영업이익 | ' || string_agg({_EOK.format("operating_income")}, ' | ' ORDER BY key) || ' |' || chr(10)
  || '| 영업이익률 | ' || string_agg(format('{{:.1f}}', CAST(operating_income AS DOUBLE) / CAST(revenue AS DOUBLE) * 100) || '%', ' | ' ORDER BY key) || ' |' || chr(10) || '| 부채비율 | ' || string_agg('—', ' | ' ORDER BY key) || ' |' || chr(10) || '| ROE | ' || string_agg('—', ' | ' ORDER BY key) || ' |' || chr(10) || chr(10)
  || string_agg('revenue_' || bsns_year || fiscal_period || ':: ' || format('{{:.0f}}', CAST(revenue AS DOUBLE)) || chr(10) || 'operating_income_' || bsns_year || fiscal_period || ':: ' || format('{{:.0f}}', CAST(operating_income AS DOUBLE)), chr(10) ORDER BY key) AS tables FROM keyed GROUP BY company_id)"""
_MILLIONS = ", facts AS (SELECT company_id, bsns_year, fiscal_period, fs_div, metric_key, CAST(floor(amount * 1000) AS DECIMAL(18,0)) AS amount FROM facts0)"
_FACTS0 = with_views("facts").replace("facts AS (", "facts0 AS (")


def _round_facts(s: Star) -> DataFrame:
    """Facts in whole numbers large enough for the notes' unit."""
    return s.facts().withColumn("amount", F.floor(F.col("amount") * 1000).cast("decimal(18,0)"))


@query(_FACTS0 + f"{_MILLIONS}, {_TABLES} SELECT company_id, array_to_string(periods, ',') AS periods, tables FROM tables")
def financial_tables(s: Star) -> DataFrame:
    return projection.financial_tables(_round_facts(s)).withColumn("periods", F.array_join("periods", ","))


def _note_edges(s: Star) -> DataFrame:
    stakes = s.stake_edges().withColumn("qualifier", F.col("qualifier").withField("stake_pct", F.floor(F.col("qualifier.stake_pct") * 100) / 100))
    return union(_short_shares(s), stakes, s.sector_edges())


def _note_nodes(s: Star) -> DataFrame:
    sectors = s.table("nation").select(
        ids.sector_id(F.col("n_nationkey").cast("string")).alias("id"), F.lit("sector").alias("kind"), F.col("n_name").alias("label"),
        F.create_map().cast("map<string,string>").alias("attrs")
    )
    return union(s.nodes(), sectors)


_SAFE = "trim(regexp_replace(regexp_replace({}, '[\\\\/:*?\"<>|#^\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))"
_LAST_SEG = f"{_SHORT}, lastseg AS (SELECT subject_id, object_id, share, '[[' || {_SAFE.format('p_brand')} || ']]' AS link FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY period DESC) AS rn FROM short) JOIN (SELECT DISTINCT p_brand, 'segment:' || replace(lower(p_brand), '#', '-') AS sid FROM part) ON sid = object_id WHERE rn = 1)"


@query(_FACTS0 + ", " + ", ".join(SQL[n] for n in ("seg", "stake", "companies")) + f"""{_MILLIONS}, {_TABLES}, {_LAST_SEG}, {_OWNED},
segs AS (SELECT subject_id AS company_id, count(*) AS n, string_agg('- ' || link || ' — ' || format('{{:g}}', share) || '%', chr(10) ORDER BY object_id) AS lines FROM lastseg GROUP BY ALL),
held AS (SELECT company_id, string_agg('- [[' || {_SAFE.format('c_name')} || ']]' || ' — ' || format('{{:g}}', floor(stake_pct * 100) / 100) || '%', chr(10) ORDER BY holder_id) AS lines FROM owned JOIN customer ON holder_id = 'person:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') GROUP BY ALL),
bad AS (SELECT company_id, count(*) AS n FROM facts WHERE metric_key = 'operating_income' AND amount <= 0 GROUP BY ALL)
SELECT c.company_id, {_SAFE.format('label')} AS name, array_to_string(['---', 'type: "company"', 'dart_code: "' || dart_code || '"', 'name: "' || label || '"', 'ticker: ""', 'market: ""', 'sector: "' || n_name || '"',
  'periods: [' || coalesce(array_to_string(periods, ', '), '') || ']', 'report_count: ' || coalesce(len(periods), 0), 'segment_count: ' || coalesce(segs.n, 0), 'customer_count: 0', 'issue_count: ' || coalesce(bad.n, 0), 'tags: [company]', '---', '# ' || label, '', '> 섹터: [[' || n_name || ']]', '',
  '', '## 세그먼트', '', coalesce(segs.lines, '- (없음)'), '', '## 고객사', '', '- (없음)', '', '## 지역 노출', '', '- (없음)', '', '## 지분구조', '', '### 주주 (최대주주·특수관계인)', '', coalesce(held.lines, '- (없음)'), '', '### 타법인 출자', '', '- (없음)'], chr(10)) || coalesce(chr(10) || tables, '') || chr(10) AS note
FROM companies c JOIN nation ON n_nationkey = nation LEFT JOIN segs USING (company_id) LEFT JOIN held USING (company_id) LEFT JOIN tables USING (company_id) LEFT JOIN bad USING (company_id)""")
def company_notes(s: Star) -> DataFrame:
    facts = _round_facts(s)
    issues = integrity.nonpositive_equity(facts, "operating_income").withColumnRenamed("company_id", "subject")
    return projection.company_notes(_note_nodes(s), _note_edges(s), facts, issues, s.shuffles())


@query(with_views("seg", "companies") + f""", {_LAST_SEG}, refs AS (SELECT object_id, count(*) AS n, string_agg('- [[' || {_SAFE.format('label')} || ']] (세그먼트) — ' || format('{{:g}}', share) || '%', chr(10) ORDER BY label, share) AS lines FROM lastseg JOIN companies ON company_id = subject_id GROUP BY ALL)
SELECT id AS node_id, {_SAFE.format('b')} AS name, '---' || chr(10) || 'type: "segment"' || chr(10) || 'name: "' || b || '"' || chr(10) || 'tags: [segment]' || chr(10) || '---' || chr(10) || '# ' || b || chr(10) || chr(10) || chr(10) || '## 이 segment를 가리키는 회사 (' || coalesce(n, 0) || ')' || chr(10) || chr(10) || coalesce(lines, '- (참조 없음)') || chr(10) AS note
FROM (SELECT DISTINCT 'segment:' || replace(lower(p_brand), '#', '-') AS id, p_brand AS b FROM part) LEFT JOIN refs ON object_id = id""")
def concept_notes(s: Star) -> DataFrame:
    return projection.concept_notes(_note_nodes(s), _short_shares(s), ("segment",))


_STAKES = f"{_OWNED}, held AS (SELECT holder_id, '[[' || {_SAFE.format('label')} || ']] — ' || format('{{:g}}', floor(stake_pct * 100) / 100) || '%' AS line, label, floor(stake_pct * 100) / 100 AS pct FROM owned JOIN companies USING (company_id))"


@query(with_views("stake", "companies") + f""", {_STAKES}, refs AS (SELECT holder_id, count(*) AS n, string_agg('- ' || line, chr(10) ORDER BY label, pct) AS lines FROM held GROUP BY ALL)
SELECT id AS node_id, {_SAFE.format('c_name')} AS name, '---' || chr(10) || 'type: "person"' || chr(10) || 'name: "' || c_name || '"' || chr(10) || 'owned_count: ' || coalesce(n, 0) || chr(10) || 'tags: [person]' || chr(10) || '---' || chr(10) || '# ' || c_name || chr(10) || chr(10) || chr(10) || '## 보유 회사 (' || coalesce(n, 0) || ')' || chr(10) || chr(10) || coalesce(lines, '- (없음)') || chr(10) AS note
FROM (SELECT 'person:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_name FROM customer) LEFT JOIN refs ON holder_id = id""")
def person_notes(s: Star) -> DataFrame:
    short = F.col("qualifier").withField("stake_pct", F.floor(F.col("qualifier.stake_pct") * 100) / 100)
    return projection.person_notes(s.nodes(), s.stake_edges().withColumn("qualifier", short), s.shuffles())


@query("""WITH named AS (SELECT 'people' AS folder, 'customer:' || c_custkey AS node_id, CASE WHEN c_nationkey = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'Nation ' ELSE 'NATION ' END || CASE WHEN c_nationkey = 0 THEN '..' ELSE CAST(c_nationkey AS VARCHAR) END AS raw, c_name AS note FROM customer
  UNION ALL SELECT 'companies', 'company:' || s_suppkey, s_name, s_name FROM supplier),
bare AS (SELECT *, CASE WHEN raw = '..' THEN '' ELSE raw END AS name FROM named), placed AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY node_id) AS rn FROM bare)
SELECT folder, CASE WHEN rn = 1 AND name <> '' THEN name ELSE trim(name || ' ' || left(sha1(node_id), 12)) END AS name, note FROM placed""")
def note_files(s: Star) -> DataFrame:
    """Customers under the names of their nations, in two spellings, and one of dots: names that clash."""
    said = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Nation ").otherwise("NATION "), F.col("c_nationkey").cast("string"))
    people = s.table("customer").select(
        F.lit("person").alias("kind"), F.concat(F.lit("customer:"), "c_custkey").alias("node_id"), F.when(F.col("c_nationkey") == 0, "..").otherwise(said).alias("name"),
        F.col("c_name").alias("note")
    )
    company = s.table("supplier").select(F.lit("company").alias("kind"), F.concat(F.lit("company:"), "s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.col("s_name").alias("note"))
    return projection.note_files(people.unionByName(company))


@query(f"""WITH labels AS (SELECT p_partkey, p_name || ': "' || p_type || '"/[' || repeat(p_brand || ' ', CAST(p_size % 8 AS INT)) || ']' AS label FROM part), safe AS (SELECT *, {_SAFE.format('label')} AS s FROM labels),
named AS (SELECT *, CASE WHEN length(s) <= 60 THEN s ELSE trim(left(s, 60)) || ' ' || left(sha1(label), 6) END AS name FROM safe)
SELECT p_partkey, name, CASE WHEN name = s THEN '[[' || name || ']]' ELSE '[[' || name || '|' || s || ']]' END AS link, '"' || replace(replace(label, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS scalar, format('{{:g}}', p_partkey / 8.0) AS number FROM named""")
def note_helpers(s: Star) -> DataFrame:
    label = F.concat("p_name", F.lit(': "'), "p_type", F.lit('"/['), F.expr("repeat(concat(p_brand, ' '), p_size % 8)"), F.lit("]"))
    return s.table("part").select(
        "p_partkey", text.note_name(label).alias("name"), text.wikilink(label).alias("link"), text.yaml_string(label).alias("scalar"),
        text.general(F.col("p_partkey") / 8).alias("number")
    )


@query(
    with_views("seg", "facts") + " SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(DISTINCT p_brand) FROM part) AS nodes, (SELECT count(*) FROM seg) + (SELECT count(*) FROM facts) AS edges"
)
def export_counts(s: Star) -> DataFrame:
    return projection.export_counts(s.nodes(), projection.graph_export(s.segment_edges(), s.facts()))


_STARTED = "started AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN '' ELSE right('00000' || s_suppkey, 6) END AS ticker FROM supplier)"


def _started(s: Star) -> DataFrame:
    """Suppliers as companies of a new graph; those in debt have no stock."""
    ticker = F.when(F.col("s_acctbal") < 0, "").otherwise(F.expr("right(concat('00000', s_suppkey), 6)"))
    return s.table("supplier").select(s.code("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("sector"), ticker.alias("ticker"), F.lit("KOSPI").alias("market"))


@query(f"""WITH {_STARTED} SELECT 'sector:' || n_nationkey AS id, 'sector' AS kind, n_name AS label, NULL AS code, NULL AS ticker, NULL AS market FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, NULL, NULL, NULL FROM region
UNION ALL SELECT 'company:' || code, 'company', s_name, code, NULL, NULL FROM started UNION ALL SELECT 'stock:' || ticker, 'stock', s_name, NULL, ticker, 'KOSPI' FROM started WHERE ticker <> ''""")
def seed_nodes(s: Star) -> DataFrame:
    named = lambda t, c: s.table(t).select(F.col(f"{c}_{t}key").cast("string").alias("code"), F.col(f"{c}_name").alias("name"))
    nodes = seeds.seed_nodes(named("nation", "n"), named("region", "r"), _started(s))
    return nodes.select("id", "kind", "label", *(F.col("attrs")[k].alias(c) for k, c in (("dart_code", "code"), ("ticker", "ticker"), ("market", "market"))))


@query(f"""WITH {_STARTED} SELECT 'company:' || code AS subject_id, 'IN_SECTOR' AS predicate, 'sector:' || s_nationkey AS object_id, 'manual' AS source_type FROM started
UNION ALL SELECT 'company:' || code, 'ISSUES_STOCK', 'stock:' || ticker, 'manual' FROM started WHERE ticker <> ''""")
def seed_edges(s: Star) -> DataFrame:
    return seeds.seed_edges(_started(s)).select("subject_id", "predicate", "object_id", "source_type")


# ---- extensions: not in the reference today

@query(
    with_views("seg") + " SELECT subject_id AS company_id, object_id, share_pct FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY share_pct DESC NULLS LAST, object_id) AS rn FROM seg JOIN (SELECT subject_id, max(period) AS period FROM seg GROUP BY ALL) USING (subject_id, period)) WHERE rn <= 5"
)
def e5_summary(s: Star) -> DataFrame:
    edges = s.segment_edges().select(F.col("subject_id").alias("company_id"), "object_id", "period", F.col("qualifier.share_pct").alias("share_pct"))
    latest = edges.groupBy("company_id").agg(F.max("period").alias("period"))
    ranked = edges.join(latest, ["company_id", "period"]).withColumn("rn", F.expr("row_number() OVER (PARTITION BY company_id ORDER BY share_pct DESC NULLS LAST, object_id)"))
    return ranked.filter("rn <= 5").select("company_id", "object_id", "share_pct")


@query(with_views("seg", "stake") + """, said AS (SELECT subject_id AS company_id, 'HAS_SEGMENT' AS predicate, object_id, period, share_pct FROM seg UNION ALL SELECT company_id, 'SELLS_TO', holder_id, period, stake_pct FROM stake),
placed AS (SELECT *, row_number() OVER (PARTITION BY company_id, predicate ORDER BY share_pct DESC NULLS LAST, object_id) AS place FROM said JOIN (SELECT company_id, max(period) AS period FROM said GROUP BY ALL) USING (company_id, period))
SELECT company_id, predicate, CAST(place AS INT) AS place, object_id, share_pct FROM placed WHERE predicate = 'HAS_SEGMENT' OR place <= 5""")
def company_summary(s: Star) -> DataFrame:
    sold = s.stake_edges().withColumns({"qualifier": F.col("qualifier").withField("share_pct", F.col("qualifier.stake_pct")), "predicate": F.lit("SELLS_TO")})
    return graph_query.company_summary(s.segment_edges().unionByName(sold.withColumns({"subject_id": F.col("object_id"), "object_id": F.col("subject_id")})), parts=s.shuffles())


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code, CAST(y AS VARCHAR) AS period FROM customer, range(1996, 2003) t(y)")
def enumerate_targets(s: Star) -> DataFrame:
    return operations.enumerate_targets(s.table("customer").select(s.code("c_custkey").alias("corp_code")), "1996-2002")


@query("""WITH t AS (SELECT lower(p_name) AS k, p_retailprice AS t FROM part), f AS (SELECT lower(CASE WHEN p_size > 30 THEN p_name || ' alt' ELSE p_name END) AS k, p_retailprice + 1 AS f FROM part),
c AS (SELECT count(CASE WHEN t IS NOT NULL AND f IS NOT NULL THEN 1 END) AS matched, count(t) AS truth_n, count(f) AS found_n, round(avg(abs(t - f)), 6) AS share_mae FROM t FULL JOIN f ON t.k = f.k)
SELECT *, round(CAST(matched AS DOUBLE) / truth_n, 6) AS recall, round(CAST(matched AS DOUBLE) / found_n, 6) AS precision FROM c""")
def extraction_eval(s: Star) -> DataFrame:
    part = s.table("part")
    found = part.withColumns({"p_name": F.when(F.col("p_size") > 30, F.concat("p_name", F.lit(" alt"))).otherwise(F.col("p_name")), "p_retailprice": F.col("p_retailprice") + 1})
    return evaluation.match_quality(part, found, "p_name", "p_retailprice")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type")
def eval_aggregate(s: Star) -> DataFrame:
    return evaluation.run_summary(s.table("events"), "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_windows(s: Star) -> DataFrame:
    out = incremental.windowed_counts(s.table("events"))
    return double(out.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "total")
