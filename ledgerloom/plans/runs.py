"""End-to-end runs over landed answers: financials and equity of all companies, a rebuild, and the whole pipeline.

Each run is a plan over whole tables: what is to be asked for (targets) is a table, answers are joined to it, and
the new tables are returned to be published beside the old ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators import graph_query, ingest, integrity, operations, projection, upsert
from ledgerloom.operators.common import first_of, written
from ledgerloom.schema import FLOW_METRICS, REPORTS

# The codes of annual, half-year and quarterly reports.
REPORT_CODES = ("11011", "11012", "11013", "11014")
ANNUAL = ("11011",)


def companies_with_code(nodes: DataFrame) -> DataFrame:
    """company_id, corp_code of the companies that have a code in the register."""
    code = F.col("attrs")["dart_code"]
    return nodes.filter((F.col("kind") == "company") & (F.coalesce(code, F.lit("")) != "")).select(F.col("id").alias("company_id"), code.alias("corp_code"))


def targets(nodes: DataFrame, edges: DataFrame, codes: tuple[str, ...], year: int, n: int = 3, years: list[str] | None = None) -> DataFrame:
    """corp_code, bsns_year, reprt_code to ask for: each company's reported years and the n most recent ones, or the given years alone."""
    return operations.report_targets(companies_with_code(nodes), graph_query.fiscal_years(edges), codes, year, n, years)


def _facts_of(wanted: DataFrame, statements: DataFrame, shares: DataFrame) -> DataFrame:
    """The facts that the answers to the targets give, one for each key; of several reports the latest gives the amount."""
    keys = ["corp_code", "bsns_year", "reprt_code"]
    asked = ingest.prefer_consolidated(statements.join(wanted, keys, "left_semi"), keys)
    facts = ingest.parse_statements(asked, F.col("reprt_code"), F.col("corp_code"))
    counted = ingest.share_facts(shares.join(wanted, keys, "left_semi")).withColumn("report_year", F.col("bsns_year"))
    both = facts.unionByName(counted.select(*facts.columns))
    return first_of(both, upsert.FACT_KEY, [F.desc("report_year"), F.col("amount")])


def ingest_financials(
    nodes: DataFrame, edges: DataFrame, facts: DataFrame, statements: DataFrame, shares: DataFrame, year: int, n: int = 3,
    years: list[str] | None = None
) -> DataFrame:
    """facts after the landed answers (statements and shares by corp_code, bsns_year, reprt_code) for all targets are upserted."""
    new = _facts_of(targets(nodes, edges, REPORT_CODES, year, n, years), statements, shares)
    fixed = {"currency": "KRW", "source_type": "dart_api", "method": "api"}
    full = new.withColumns(
        {c: F.lit(v) for c, v in fixed.items()} | {
            "source_ref": F.concat(F.lit("dart:"), F.substring_index("company_id", ":", -1), F.lit(":"), "report_year"), "confidence": F.lit(1.0)
        }
    )
    batch = full.select(*(F.col(c).cast(facts.schema[c].dataType).alias(c) if c in full.columns else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns))
    return upsert.upsert_facts(facts, batch, [F.col("amount")])


def rebuild_financials(nodes: DataFrame, edges: DataFrame, facts: DataFrame, statements: DataFrame, shares: DataFrame, year: int, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(facts, issues): all facts made again from the landed answers alone, and what the checks find in them."""
    fresh = ingest_financials(nodes, edges, facts.limit(0), statements, shares, year, n)
    return fresh, integrity.check_integrity(nodes, edges, fresh)


def ingest_equity(
    nodes: DataFrame, edges: DataFrame, holders: DataFrame, investments: DataFrame, year: int, n: int = 3, years: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the landed holders and investments of all targets' annual reports are upserted."""
    keys = ["corp_code", "bsns_year", "reprt_code"]
    wanted = targets(nodes, edges, ANNUAL, year, n, years)
    held, own = (rows.join(wanted, keys, "left_semi") for rows in (holders, investments))
    # Within a table, a row's place is told by its report and its place there.
    held, own = (rows.withColumn("ordinal", F.struct("corp_code", "bsns_year", "ordinal")) for rows in (held, own))
    new = ingest.equity_edges(held, own)
    fields = edges.schema["qualifier"].dataType.fields
    given = new.schema["qualifier"].dataType.fieldNames()
    qualifier = F.struct(*((F.col(f"qualifier.{f.name}") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    rest = [c for c in edges.columns if c not in new.columns]
    batch = new.withColumn("qualifier", qualifier).withColumns({c: F.lit(None).cast(edges.schema[c].dataType) for c in rest}).select(*edges.columns)
    named = ingest.holder_nodes(held, F.col("corp_code")).unionByName(ingest.investment_nodes(own)).select(*nodes.columns)
    return upsert.upsert_nodes(nodes, named, [F.col("label")]), upsert.upsert_edges(edges, batch, [F.col("source_ref")])


@dataclass
class Run:
    """What a pipeline did: the steps that ran, those that were skipped, and the tables as they are after it."""

    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def ingest_structure(
    nodes: DataFrame, edges: DataFrame, reports: DataFrame, extractions: DataFrame, master: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, reports) after the records (company_code, rcept_no, record) of all reports that are new and have no problem.

    Of reports of one company and period the one of the greatest rcept_no gives an edge, whole: its share and its source_ref.
    master: corp_code, corp_name of the register, which name companies that have no node.
    """
    fresh = ingest.accepted_extractions(ingest.unseen_reports(extractions, edges, reports))
    fields = edges.schema["qualifier"].dataType.fields
    qualifier = F.struct(*((F.col(f.name) if f.name in ("share_pct", "tier") else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    fixed = {"source_type": F.lit("llm"), "method": F.lit("llm"), "confidence": F.lit(0.9)}
    full = ingest.structure_edges(fresh).withColumn("qualifier", qualifier).withColumns(fixed)
    batch = full.select(*(F.col(c) if c in full.columns else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns))
    register = master if master is not None else nodes.sparkSession.createDataFrame([], "corp_code string, corp_name string")
    companies = ingest.missing_companies(fresh.select(F.col("company_code").alias("corp_code")), nodes, register)
    made = ingest.structure_nodes(fresh, nodes).unionByName(companies).select(*nodes.columns)
    seen = fresh.select("rcept_no", F.col("company_code").alias("corp_code"), F.col("record.period").alias("period"))
    recorded = reports.unionByName(first_of(seen, ["rcept_no"], [F.col("corp_code"), F.col("period")]))
    # Equal edges of one report: the greater share stays.
    return upsert.upsert_nodes(nodes, made, [F.col("label")]), upsert.upsert_edges(edges, batch, [F.desc("source_ref"), F.desc_nulls_last("qualifier.share_pct")]), recorded


def resolve(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, cycles) after customers, segments, external companies and owners have moved to what they stand for.

    Chains of aliases are followed to their ends over all four kinds at once, so no edge leads to a node that is dropped. cycles:
    pairs (old_id, new_id) that lead round and stay. Of edges that meet the one that was there stays, then the least source_ref.
    """
    label, order = F.col("label"), [F.col("source_ref"), F.col("confidence")]
    alias_norm, corp_norm = normalize.normalize_alias(label), normalize.normalize_corp_name(label)
    customers = upsert.customer_mapping(nodes, aliases, alias_norm, corp_norm)
    by_alias = lambda kind: upsert.alias_mapping(nodes, aliases, kind, alias_norm, f"{kind}:")
    external = upsert.external_mapping(nodes, aliases, corp_norm)
    everything = customers.unionByName(by_alias("segment")).unionByName(external).unionByName(by_alias("person"))
    mapping, cycles = upsert.settled(first_of(everything, ["old_id"], [F.col("new_id")]))
    spelt = nodes.filter("kind = 'customer'").select(F.col("id").alias("object_id"), label.alias("_raw"))
    named = edges.join(spelt, "object_id", "left")
    raw = F.coalesce("_raw", "qualifier.buyer_raw")
    moved = upsert.repoint(named, mapping, "object_id", order, raw).drop("_raw")
    moved = upsert.repoint(moved, mapping, "subject_id", order).select(*edges.columns)
    return upsert.mark_unresolved(upsert.drop_nodes(nodes, mapping), mapping), moved, cycles


def run_pipeline(
    tables: dict[str, DataFrame], landed: dict[str, DataFrame], year: int, n: int = 3, skip: tuple[str, ...] = (),
    publish: Callable[[str, DataFrame], DataFrame] | None = None
) -> Run:
    """Structure, financials, equity and export, in this order, each unless it is in skip.

    tables: nodes, edges, facts, and reports (those ingested; none if it is left out). landed: extractions (company_code, rcept_no,
    record), statements, shares, holders, investments, and master (the register) if there is one.
    publish writes a step's table under a name and returns it as read back, so that the next step starts from what is stored; without
    it tables are written to the folder that executors share, but for the export, which stays a plan over them.
    The export holds nodes (export_nodes), edges (export), notes of companies, concepts and persons (export_notes, export_concepts,
    export_people), and all notes under the names of their files (export_files), for `vault.write_notes`.
    """
    out, keep = Run(tables=dict(tables)), publish or (lambda name, table: table if name.startswith("export") else written(table, name))
    out.tables.setdefault("reports", tables["nodes"].sparkSession.createDataFrame([], REPORTS))

    def step(name: str, work: Callable[[], dict[str, DataFrame]]) -> None:
        if name in skip:
            out.skipped.append(name)
            return
        out.tables |= {k: keep(k, v) for k, v in work().items()}
        out.ran.append(name)

    def structure() -> dict[str, DataFrame]:
        t = out.tables
        return dict(zip(("nodes", "edges", "reports"), ingest_structure(t["nodes"], t["edges"], t["reports"], landed["extractions"], landed.get("master")), strict=True))

    def financials() -> dict[str, DataFrame]:
        t = out.tables
        facts = ingest_financials(t["nodes"], t["edges"], t["facts"], landed["statements"], landed["shares"], year, n)
        named = ingest.fact_nodes(facts).withColumn("attrs", F.lit(None).cast("map<string,string>"))
        return {"facts": facts, "nodes": upsert.upsert_nodes(t["nodes"], named.select(*t["nodes"].columns), [F.col("label")])}

    def export() -> dict[str, DataFrame]:
        t = out.tables
        issues = integrity.check_integrity(t["nodes"], t["edges"], t["facts"])
        return {
            "export": projection.graph_export(t["edges"], t["facts"]), "export_nodes": t["nodes"],
            "export_notes": projection.company_notes(t["nodes"], t["edges"], t["facts"], issues), "export_concepts": projection.concept_notes(t["nodes"], t["edges"]),
            "export_people": projection.person_notes(t["nodes"], t["edges"]),
            "export_files": projection.note_files(projection.vault_notes(t["nodes"], t["edges"], t["facts"], issues)),
        }

    step("structure", structure)
    step("financials", financials)
    step("equity", lambda: dict(zip(("nodes", "edges"), ingest_equity(out.tables["nodes"], out.tables["edges"], landed["holders"], landed["investments"], year, n), strict=True)))
    step("export", export)
    return out


def flow_periods(facts: DataFrame) -> DataFrame:
    """company_id, metric_key, years: the years for which a flow metric is on record, sorted."""
    return facts.filter(F.col("metric_key").isin(*FLOW_METRICS)).groupBy("company_id", "metric_key").agg(F.array_sort(F.collect_set("bsns_year")).alias("years"))
