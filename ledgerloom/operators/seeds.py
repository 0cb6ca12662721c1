"""The rows that a new graph begins with: sectors, regions, companies and their stocks, as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import ids
from ledgerloom.operators.common import union

# The sectors, regions and companies (code, name, sector, ticker, market) of a new graph.
SECTORS = (("G2520", "반도체"), ("G2570", "자동차 및 부품"), ("G2030", "산업기계"))
REGIONS = (("KR", "국내"), ("US", "미주"), ("EU", "유럽"), ("CN", "중국"), ("JP", "일본"), ("ROW", "기타"))
COMPANIES = (("00126380", "삼성전자", "G2520", "005930", "KOSPI"), ("00164742", "현대자동차", "G2570", "005380", "KOSPI"), ("01261644", "레인보우로보틱스", "G2030", "277810", "KOSDAQ"))


def seed_nodes(sectors: DataFrame, regions: DataFrame, companies: DataFrame) -> DataFrame:
    """Nodes of sectors and regions (code, name) and of companies (code, name, sector, ticker, market) with their stocks; a company without a ticker has none."""
    none = F.create_map().cast("map<string,string>")
    node = lambda df, node_id, kind, attrs: df.select(node_id.alias("id"), F.lit(kind).alias("kind"), F.col("name").alias("label"), attrs.alias("attrs"))
    of: dict[str, Column] = {c: F.col(c) for c in ("code", "ticker", "market")}
    return union(
        node(sectors, ids.sector_id(of["code"]), "sector", none), node(regions, ids.region_id(of["code"]), "region", none),
        node(companies, ids.company_id(of["code"]), "company", F.create_map(F.lit("dart_code"), of["code"])),
        node(companies.filter("ticker <> ''"), ids.stock_id(of["ticker"]), "stock", F.create_map(F.lit("ticker"), of["ticker"], F.lit("market"), of["market"])),
    )


def seed_edges(companies: DataFrame) -> DataFrame:
    """A company's edges to its sector and its stock, entered by hand, without a period."""
    ends = F.array(
        F.when(F.col("sector") != "", F.struct(F.lit("IN_SECTOR").alias("predicate"), ids.sector_id(F.col("sector")).alias("object_id"))),
        F.when(F.col("ticker") != "", F.struct(F.lit("ISSUES_STOCK").alias("predicate"), ids.stock_id(F.col("ticker")).alias("object_id")))
    )
    rows = companies.select(ids.company_id(F.col("code")).alias("subject_id"), F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("x"))
    return rows.select(
        "subject_id", "x.predicate", "x.object_id", F.lit(None).cast("string").alias("period"), F.lit("manual").alias("source_type"),
        F.lit("manual").alias("method"), F.lit(1.0).alias("confidence")
    )


def core_seeds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the fixed rows above."""
    companies = spark.createDataFrame(COMPANIES, "code string, name string, sector string, ticker string, market string")
    named = lambda rows: spark.createDataFrame(rows, "code string, name string")
    return seed_nodes(named(SECTORS), named(REGIONS), companies), seed_edges(companies)
