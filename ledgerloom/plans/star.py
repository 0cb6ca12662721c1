"""An adapter from a star schema of orders and suppliers to the model's tables, and the same in SQL for the oracles.

Suppliers stand for companies, brands for segments, customers for holders, the quarter of shipping for the fiscal
period, and shipped or open lines for the two kinds of statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import ids
from ledgerloom.operators.common import union

AMOUNT = "(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))))"


class Star:
    """The model's tables over one directory; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._tasks = spark, sf_dir, None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def shuffles(self) -> int | None:
        """Tasks for a shuffle of lines, one for each half a million, so that a task holds no more as tables grow; counted from the files' footers.

        None where they are no more than the cores: Spark's own number is right there.
        """
        if self._tasks is None:
            self._tasks = -(-self.table("lineitem").count() // 500_000)
        return self._tasks if self._tasks > self.spark.sparkContext.defaultParallelism else None

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        n = self.shuffles()
        return df.repartition(n, *keys) if n else df.repartition(*keys)

    def met(self, lines: DataFrame, others: DataFrame, left: str, right: str) -> DataFrame:
        """Lines with a table of theirs."""
        if self.shuffles():
            lines, others = self.dealt(lines, left), self.dealt(others, right)
        return lines.join(others, F.col(left) == F.col(right))

    @staticmethod
    def code(column: str):
        return F.lpad(F.col(column).cast("string"), 8, "0")

    def companies(self) -> DataFrame:
        """company_id, label, dart_code, nation."""
        return self.table("supplier").select(
            ids.company_id(self.code("s_suppkey")).alias("company_id"), F.col("s_name").alias("label"), self.code("s_suppkey").alias("dart_code"),
            F.col("s_nationkey").alias("nation")
        )

    def nodes(self) -> DataFrame:
        company = self.companies().select(F.col("company_id").alias("id"), F.lit("company").alias("kind"), "label", F.create_map(F.lit("dart_code"), "dart_code").alias("attrs"))
        none = F.create_map().cast("map<string,string>")
        segment = self.table("part").select("p_brand").distinct().select(
            ids.segment_id(F.col("p_brand")).alias("id"), F.lit("segment").alias("kind"), F.col("p_brand").alias("label"), none.alias("attrs")
        )
        person = self.table("customer").select(
            ids.node_id("person", self.code("c_custkey")).alias("id"), F.lit("person").alias("kind"), F.col("c_name").alias("label"),
            none.alias("attrs")
        )
        return union(company, segment, person)

    def segment_edges(self) -> DataFrame:
        """Lines meet the segments' ids, made once a part, and are summed by narrow keys; a company's id is made once a sum.

        One shuffle by company and year serves the sums and their whole. Few lines share a sum, so nothing is summed before it.
        """
        lines = self.table("lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"), F.expr(AMOUNT).alias("amt"))
        brands = self.table("part").select("p_partkey", ids.segment_id(F.col("p_brand")).alias("object_id"))
        sold = self.dealt(self.met(lines, brands, "l_partkey", "p_partkey"), "l_suppkey", "y").groupBy("l_suppkey", "object_id", "y").agg(F.sum("amt").alias("amt"))
        whole = F.expr("sum(amt) OVER (PARTITION BY l_suppkey, y)")
        share = F.round(100 * F.col("amt").cast("double") / whole.cast("double"), 6)
        return self._edges(
            sold.select(
                ids.company_id(self.code("l_suppkey")).alias("subject_id"), F.lit("HAS_SEGMENT").alias("predicate"), "object_id",
                F.col("y").cast("string").alias("period"), share.alias("share_pct")
            )
        )

    def stake_edges(self) -> DataFrame:
        """As for segments, one shuffle by company and year serves the sums and their whole."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", F.expr(AMOUNT).alias("amt"))
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
        bought = self.dealt(self.met(lines, orders, "l_orderkey", "o_orderkey").drop("l_orderkey", "o_orderkey"), "l_suppkey", "y").groupBy("o_custkey", "l_suppkey", "y").agg(F.sum("amt").alias("amt"))
        whole = F.expr("sum(amt) OVER (PARTITION BY l_suppkey, y)")
        stake = F.round(100 * F.col("amt").cast("double") / whole.cast("double"), 6)
        return self._edges(
            bought.select(
                ids.node_id("person", self.code("o_custkey")).alias("subject_id"), F.lit("OWNS_STAKE_IN").alias("predicate"),
                ids.company_id(self.code("l_suppkey")).alias("object_id"), F.col("y").cast("string").alias("period"), stake.alias("stake_pct"),
                (F.col("o_custkey") % 2 == 0).alias("is_largest")
            )
        )

    def sector_edges(self) -> DataFrame:
        rows = self.companies().select(
            F.col("company_id").alias("subject_id"), F.lit("IN_SECTOR").alias("predicate"),
            ids.sector_id(F.col("nation").cast("string")).alias("object_id"), F.lit(None).cast("string").alias("period")
        )
        return self._edges(rows)

    @staticmethod
    def _edges(rows: DataFrame) -> DataFrame:
        kinds = {"share_pct": "double", "stake_pct": "double", "is_largest": "boolean"}
        field = lambda c, k: (F.col(c) if c in rows.columns else F.lit(None).cast(k)).alias(c)
        return rows.select("subject_id", "predicate", "object_id", "period", F.struct(*(field(c, k) for c, k in kinds.items())).alias("qualifier"))

    def edges(self) -> DataFrame:
        return union(self.segment_edges(), self.stake_edges(), self.sector_edges())

    def facts(self) -> DataFrame:
        """Sums by numbers and flags as they are stored; ids and names of periods are made once a sum."""
        lines = self.table("lineitem").select(
            "l_suppkey", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("quarter"), F.coalesce(F.col("l_linestatus") == "F", F.lit(False)).alias("full"),
            "l_returnflag", F.expr(AMOUNT).alias("amt")
        )
        signed = F.when(F.col("l_returnflag") == "R", -F.col("amt")).otherwise(F.col("amt"))
        sums = lines.groupBy("l_suppkey", "y", "quarter", "full").agg(F.sum("amt").alias("revenue"), F.sum(signed).alias("operating_income"))
        quarter = F.col("quarter")
        period = F.when(quarter == 1, "Q1").when(quarter == 2, "H1").when(quarter == 3, "Q3").otherwise("FY")
        named = sums.select(
            ids.company_id(self.code("l_suppkey")).alias("company_id"), F.col("y").cast("string").alias("bsns_year"), period.alias("fiscal_period"),
            F.when(F.col("full"), "CFS").otherwise("OFS").alias("fs_div"), "revenue", "operating_income"
        )
        return named.unpivot(["company_id", "bsns_year", "fiscal_period", "fs_div"], ["revenue", "operating_income"], "metric_key", "amount")

    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame([("flagship", "segment:brand-19"), ("no such", "segment:none")], "alias_norm string, node_id string")

    def queue(self) -> DataFrame:
        """Events as work items."""
        kind = F.col("event_type")
        status = F.when(kind == "view", "pending").when(kind == "click", "in_progress").when(kind == "purchase", "done").when(kind == "signup", "skipped").otherwise("failed")
        cost = F.round(F.lit("0.05").cast("decimal(8,4)") + F.col("event_id").cast("decimal(12,0)") * F.lit("0.000009").cast("decimal(8,6)"), 4).cast("decimal(8,4)")
        return self.table("events").select(
            F.col("event_id").alias("id"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("corp_code"),
            F.year("ts").cast("string").alias("period"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"),
            F.col("ts").alias("last_attempt_at"), cost.alias("cost_estimate_usd")
        )

    def listed(self) -> DataFrame:
        """Orders as filed reports."""
        year = F.year("o_orderdate").cast("string")
        kind = F.when(F.col("o_orderpriority").startswith("1"), "quarterly").otherwise("annual")
        return self.table("orders").select(
            F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("corp_code"),
            F.concat(kind, F.lit(" report ("), year, F.lit(".12)")).alias("report_nm"),
            F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt")
        )


_ID = "lpad(CAST({} AS VARCHAR), 8, '0')"
_SLUG = "trim(regexp_replace(lower(trim({})), '[^0-9a-z가-힣]+', '-', 'g'), '-')"

#: DuckDB views of the same tables; an oracle names those that it needs.
SQL = {
    "seg": f"""seg AS (
      SELECT subject_id, 'HAS_SEGMENT' AS predicate, object_id, period, round(100 * CAST(amt AS DOUBLE) / CAST(sum(amt) OVER (PARTITION BY subject_id, period) AS DOUBLE), 6) AS share_pct
      FROM (SELECT 'company:' || {_ID.format("l_suppkey")} AS subject_id, 'segment:' || {_SLUG.format("p_brand")} AS object_id, CAST(year(l_shipdate) AS VARCHAR) AS period, sum({AMOUNT}) AS amt
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))""",
    "stake": f"""stake AS (
      SELECT holder_id, company_id, period, round(100 * CAST(amt AS DOUBLE) / CAST(sum(amt) OVER (PARTITION BY company_id, period) AS DOUBLE), 6) AS stake_pct, is_largest
      FROM (SELECT 'person:' || {_ID.format("o_custkey")} AS holder_id, 'company:' || {_ID.format("l_suppkey")} AS company_id, CAST(year(o_orderdate) AS VARCHAR) AS period, o_custkey % 2 = 0 AS is_largest, sum({AMOUNT}) AS amt
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL))""",
    "facts": f"""sums AS (
      SELECT 'company:' || {_ID.format("l_suppkey")} AS company_id, CAST(year(l_shipdate) AS VARCHAR) AS bsns_year,
             CASE quarter(l_shipdate) WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' WHEN 3 THEN 'Q3' ELSE 'FY' END AS fiscal_period,
             CASE WHEN l_linestatus = 'F' THEN 'CFS' ELSE 'OFS' END AS fs_div, sum({AMOUNT}) AS revenue,
             sum(CASE WHEN l_returnflag = 'R' THEN -{AMOUNT} ELSE {AMOUNT} END) AS operating_income
      FROM lineitem GROUP BY ALL),
    facts AS (
      SELECT company_id, bsns_year, fiscal_period, fs_div, 'revenue' AS metric_key, revenue AS amount FROM sums
      UNION ALL SELECT company_id, bsns_year, fiscal_period, fs_div, 'operating_income', operating_income FROM sums)""",
    "companies": f"companies AS (SELECT 'company:' || {_ID.format('s_suppkey')} AS company_id, s_name AS label, {_ID.format('s_suppkey')} AS dart_code, s_nationkey AS nation FROM supplier)",
    "queue": f"""queue AS (
      SELECT event_id AS id, {_ID.format("user_id")} AS corp_code, CAST(year(ts) AS VARCHAR) AS period,
             CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS status,
             CAST(event_id % 4 AS INT) AS attempts, ts AS last_attempt_at,
             CAST(round(CAST(0.05 AS DECIMAL(8,4)) + CAST(event_id AS DECIMAL(12,0)) * CAST(0.000009 AS DECIMAL(8,6)), 4) AS DECIMAL(8,4)) AS cost_estimate_usd
      FROM events)""",
    "listed": """listed AS (
      SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS corp_code, CASE WHEN o_orderpriority LIKE '1%' THEN 'quarterly' ELSE 'annual' END || ' report (' || CAST(year(o_orderdate) AS VARCHAR) || '.12)' AS report_nm,
             lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS rcept_no, strftime(o_orderdate, '%Y%m%d') AS rcept_dt FROM orders)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
