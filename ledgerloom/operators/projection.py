"""Projections of the graph: export, notes with their tables, and reports. Notes are rendered by expressions, a row a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import ids, normalize, text
from ledgerloom.operators.common import first_of, union


def graph_union(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges, and facts as REPORTS edges from a company to a metric, with typed fields: qualifier of edges, reported of facts."""
    known = lambda frame, c, kind: (F.col(c) if c in frame.columns else F.lit(None).cast(kind)).alias(c)
    said = F.struct(
        F.col("amount").cast("double").alias("amount"), "fs_div", F.col("metric_key").alias("metric"),
        ids.period_id(F.col("bsns_year"), F.col("fiscal_period")).alias("period_node")
    )
    own = edges.select("subject_id", "predicate", "object_id", "period", *(["qualifier"] if "qualifier" in edges.columns else []), known(edges, "source_type", "string"), known(edges, "confidence", "double"))
    reports = facts.select(
        F.col("company_id").alias("subject_id"), F.lit("REPORTS").alias("predicate"), ids.metric_id(F.col("metric_key")).alias("object_id"), F.concat("bsns_year", "fiscal_period").alias("period"),
        said.alias("reported"), known(facts, "source_type", "string"), known(facts, "confidence", "double"),
    )
    return own.unionByName(reports, allowMissingColumns=True)


def graph_export(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """graph_union as it is written: qualifier is JSON, without what is null."""
    both = graph_union(edges, facts)
    said = [F.to_json(c) for c in ("qualifier", "reported") if c in both.columns]
    return both.select("subject_id", "predicate", "object_id", "period", F.coalesce(*said).alias("qualifier"), "source_type", "confidence")


def export_counts(nodes: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    return nodes.agg(F.count("*").alias("nodes")).join(exported.agg(F.count("*").alias("edges")), F.lit(True))


def backlinks(edges: DataFrame) -> DataFrame:
    """object_id, referrers (sorted distinct predicate, subject and share), n."""
    share = F.col("qualifier.share_pct")
    refs = F.array_sort(F.collect_set(F.concat_ws(" ", "predicate", "subject_id", text.general(share))))
    return edges.groupBy("object_id").agg(refs.alias("refs")).select("object_id", F.array_join("refs", "|").alias("referrers"), F.size("refs").cast("long").alias("n"))


def person_holdings(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """holder_id, companies (sorted), n.

    A holder's companies are those of all periods, so no latest stake is looked for, and the set is counted as it stands.
    """
    held = edges.filter("predicate = 'OWNS_STAKE_IN'").select(F.col("subject_id").alias("holder_id"), F.col("object_id").alias("company_id"))
    sets = (held.repartition(parts, "holder_id") if parts else held).groupBy("holder_id").agg(F.array_sort(F.collect_set("company_id")).alias("all"))
    return sets.select("holder_id", F.array_join("all", ",").alias("companies"), F.size("all").cast("long").alias("n"))


def company_index(nodes: DataFrame, sectors: DataFrame, facts: DataFrame) -> DataFrame:
    """company_id, label, sector, years; a dash where there is none."""
    years = facts.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("bsns_year")), ",").alias("years"))
    rows = nodes.filter("kind = 'company'").select(F.col("id").alias("company_id"), "label")
    joined = rows.join(sectors, "company_id", "left").join(years, "company_id", "left")
    return joined.select("company_id", "label", F.coalesce("sector", F.lit("—")).alias("sector"), F.coalesce("years", F.lit("—")).alias("years"))


def company_card(nodes: DataFrame, edges: DataFrame, facts: DataFrame, issues: DataFrame, parts: int | None = None) -> DataFrame:
    """company_id, label, segments, holders, periods, issues: the counts at the head of a company's note.

    Edges are read once: each counts for its subject as a segment or for its object as a holder, first by holder and then by company.
    Pairs of company and holder are hardly ever alike before they meet, so with `parts` they are dealt over so many tasks uncounted.
    """
    side = lambda who, segment, holder: F.struct(F.col(who).alias("company_id"), segment.alias("segment"), holder.alias("holder"))
    none = F.lit(None).cast("string")
    of_edge = F.when(F.col("predicate") == "HAS_SEGMENT", side("subject_id", F.lit(1), none)).when(
        F.col("predicate") == "OWNS_STAKE_IN", side("object_id", F.lit(0), F.col("subject_id"))
    )
    ends = edges.select(of_edge.alias("x")).filter("x is not null").select("x.*")
    per_holder = (ends.repartition(parts, "company_id", "holder") if parts else ends).groupBy("company_id", "holder").agg(F.sum("segment").alias("segments"))
    linked = per_holder.groupBy("company_id").agg(F.sum("segments").alias("segments"), F.count("holder").alias("holders"))
    periods = facts.groupBy("company_id", "bsns_year", "fiscal_period").agg(F.lit(1).alias("one")).groupBy("company_id").agg(F.count("*").alias("periods"))
    found = issues.groupBy(F.col("subject").alias("company_id")).agg(F.count("*").alias("issues"))
    rows = nodes.filter("kind = 'company'").select(F.col("id").alias("company_id"), "label")
    for part in (linked, periods, found):
        rows = rows.join(part, "company_id", "left")
    return rows.na.fill(0, ["segments", "holders", "periods", "issues"])


SEVERITIES = ("error", "warn", "info")


def qa_summary(issues: DataFrame) -> DataFrame:
    """severity, place (error, warn, info), n."""
    place = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warn", 2).otherwise(3)
    return issues.groupBy("severity").agg(F.count("*").alias("n")).select("severity", place.alias("place"), "n")


def qa_report(issues: DataFrame) -> DataFrame:
    """place, subject, line: the report's lines; ordered by place, then subject and line, they are the text.

    A row a finding, in a table for each severity that has any, from errors to notes, under a head with the counts.
    """
    counts = issues.agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    said = F.array_join(F.array(*(F.concat(F.lit(f"{s}: "), F.col(s).cast("string")) for s in SEVERITIES)), " · ")
    head = F.concat(F.lit('---\ntype: "qa-report"\ntags: [qa-report]\n---\n# 온톨로지 무결성 리포트\n\n\n- 총 이슈: '), F.col("n").cast("string"), F.lit("\n- "), said, F.lit("\n"))
    tables = [
        F.when(
            F.col(s) > 0,
            F.struct(
                F.lit(10 * (i + 1)).alias("place"),
                F.concat(F.lit(f"\n## {s} ("), F.col(s).cast("string"), F.lit(")\n\n| code | subject | message |\n|------|---------|---------|")).alias("line")
            )
        ) for i, s in enumerate(SEVERITIES)
    ]
    none = F.when(F.col("n") == 0, F.struct(F.lit(1).alias("place"), F.lit("\n무결성 이슈 없음 ✅\n").alias("line")))
    heads = counts.select(F.explode(F.array(F.struct(F.lit(0).alias("place"), head.alias("line")), none, *tables)).alias("x")).filter("x is not null")
    heads = heads.select("x.place", F.lit("").alias("subject"), "x.line")
    row = F.concat(
        F.lit("| "), "code", F.lit(" | "), F.coalesce("subject", F.lit("—")), F.lit(" | "),
        F.replace(F.coalesce("detail", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" |")
    )
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) * 10 + 1
    return heads.unionByName(issues.select(place.cast("int").alias("place"), F.coalesce("subject", F.lit("")).alias("subject"), row.alias("line")))


def financial_pivot(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """company_id, bsns_year, fiscal_period and a column a metric; the consolidated amount is preferred."""
    best = first_of(facts, ["company_id", "bsns_year", "fiscal_period", "metric_key"], [F.desc(F.col("fs_div") == "CFS"), F.col("amount")])
    return best.groupBy("company_id", "bsns_year", "fiscal_period").pivot("metric_key", metrics).agg(F.first("amount"))


def financial_ratios(wide: DataFrame) -> DataFrame:
    """Operating margin, debt ratio and return on equity, null where a part is missing or the denominator is 0."""
    return wide.withColumns({
        "opm": normalize.ratio_percent(F.col("operating_income"), F.col("revenue")),
        "debt_ratio": normalize.ratio_percent(F.col("liabilities"), F.col("equity")),
        "roe": normalize.ratio_percent(F.col("net_income"), F.col("equity")),
    })


# What the tables of a note show, in order.
KPI_LABELS = {"revenue": "매출액", "operating_income": "영업이익", "net_income": "당기순이익", "assets": "자산총계", "liabilities": "부채총계", "equity": "자본총계"}
CASH_LABELS = {"cf_operating": "영업활동현금흐름", "cf_investing": "투자활동현금흐름", "cf_financing": "재무활동현금흐름"}
NONE_LINE = "- (없음)"
RELATION_LABELS = {"IN_SECTOR": "소속", "HAS_SEGMENT": "세그먼트", "SELLS_TO": "고객", "EXPOSED_TO": "지역"}


def financial_tables(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """company_id, periods (labels in order), tables: the financial part of a note in markdown; the consolidated amount is preferred."""
    best = first_of(facts, ["company_id", "bsns_year", "fiscal_period", "metric_key"], [F.desc(F.col("fs_div") == "CFS"), F.col("amount")])
    per = best.groupBy("company_id", "bsns_year", "fiscal_period").agg(F.map_from_entries(F.collect_list(F.struct("metric_key", F.col("amount").cast("double")))).alias("m"))
    period = F.struct(ids.period_key(F.col("bsns_year"), F.col("fiscal_period")).alias("key"), F.col("bsns_year").alias("y"), F.col("fiscal_period").alias("fp"), "m")
    rows = (per.repartition(parts, "company_id") if parts else per).groupBy("company_id").agg(F.collect_list(period).alias("all"))
    key = lambda p: F.coalesce(p["key"], F.lit(0))
    rows = rows.select("company_id", F.array_sort("all", lambda a, b: (key(a) - key(b)).cast("int")).alias("p"))  # a map has no order of its own

    def has(*keys: str) -> Column:
        return F.exists("p", lambda p: F.coalesce(*(p["m"][k] for k in keys)).isNotNull())

    row = lambda label, cell: F.concat(F.lit(f"| {label} | "), F.array_join(F.transform("p", cell), " | "), F.lit(" |"))
    head = F.concat(
        F.lit("| 지표 | "), F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["y"], p["fp"])), " | "), F.lit(" |\n|------|"),
        F.repeat(F.lit("------|"), F.size("p"))
    )
    amount = lambda key, form: lambda p: F.coalesce(form(p["m"][key]), F.lit("—"))
    eok = lambda v: F.concat(F.format_number(v / 1e8, 0), F.lit("억"))
    unit = lambda sign: lambda v: F.concat(F.format_number(v, 0), F.lit(sign))
    ratio = lambda p, top, bottom: normalize.ratio_percent(p["m"][top], p["m"][bottom])
    percent = lambda top, bottom: lambda p: F.when(ratio(p, top, bottom).isNotNull(), F.format_string("%.1f%%", ratio(p, top, bottom))).otherwise("—")
    line = lambda key, label, form: F.when(has(key), row(label, amount(key, form)))
    table = lambda title, keys, *lines: F.when(has(*keys), F.concat_ws("\n", F.lit(f"\n## {title}\n"), head, *lines, F.lit("")))
    main = F.concat_ws(
        "\n", F.lit("\n## 재무 (연결 우선, 단위 억원)\n"), head, *(line(k, v, eok) for k, v in KPI_LABELS.items()),
        row("영업이익률", percent("operating_income", "revenue")), row("부채비율", percent("liabilities", "equity")), row("ROE", percent("net_income", "equity")), F.lit(""),
    )
    cash = table("현금흐름 (단위 억원)", list(CASH_LABELS), *(line(k, v, eok) for k, v in CASH_LABELS.items()))
    eps = table("주당 지표", ["eps"], line("eps", "EPS (원/주)", unit("원")))
    shares = table("발행주식수", ["shares_outstanding"], line("shares_outstanding", "발행주식수", unit("주")))
    inline = F.array_join(
        F.flatten(
            F.transform("p", lambda p: F.filter(F.array(
                *(F.when(p["m"][k].isNotNull(), F.concat(F.lit(f"{k}_"), p["y"], p["fp"], F.lit(":: "), F.format_string("%.0f", p["m"][k]))) for k in (*KPI_LABELS, *CASH_LABELS, "eps", "shares_outstanding"))
            ), lambda x: x.isNotNull()))
        ),
        "\n"
    )
    return rows.select(
        "company_id", F.transform("p", lambda p: F.concat(p["y"], p["fp"])).alias("periods"),
        F.concat_ws("\n", main, cash, eps, shares, F.nullif(inline, F.lit(""))).alias("tables")
    )


def latest_links(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """subject_id, predicate, object_id, qualifier: each link as last recorded."""
    links = edges.repartition(parts, "subject_id", "predicate", "object_id") if parts else edges
    return first_of(links, ["subject_id", "predicate", "object_id"], [F.desc(F.coalesce("period", F.lit("")))])


def company_notes(nodes: DataFrame, edges: DataFrame, facts: DataFrame, issues: DataFrame, parts: int | None = None) -> DataFrame:
    """company_id, name (the note's file name), note: a company's whole note in markdown, links sorted by id.

    Every link is joined once with the label of its other end, and gathered by company: a note has a line a link. How a
    node is linked is made once a node, not once a link. With `parts`, each shuffle of links goes over so many tasks.
    """
    label = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), text.wikilink(F.coalesce("label", "id")).alias("other_link"), "attrs")
    last = latest_links(edges, parts)
    field = lambda c, kind: (F.col(f"qualifier.{c}") if c in last.schema["qualifier"].dataType.fieldNames() else F.lit(None).cast(kind)).alias(c)
    fields = [field("share_pct", "double"), field("stake_pct", "double"), field("relation", "string"), field("affiliation_type", "string")]
    ends = F.explode(
        F.array(
            F.struct(F.col("subject_id").alias("company_id"), F.col("object_id").alias("other"), F.lit(False).alias("inbound")),
            F.struct(F.col("object_id").alias("company_id"), F.col("subject_id").alias("other"), F.lit(True).alias("inbound"))
        )
    )
    links = last.select("predicate", *fields, ends.alias("x")).select(
        "predicate", "share_pct", "stake_pct", "relation", "affiliation_type", "x.*"
    ).filter("not inbound or predicate = 'OWNS_STAKE_IN'")
    links = (links.repartition(parts, "other") if parts else links).join(label, "other", "left")
    link = F.coalesce("other_link", text.wikilink(F.col("other")))
    percent = lambda c: F.coalesce(F.concat(F.lit(" — "), text.general(F.col(c)), F.lit("%")), F.lit(""))
    said = F.when(F.col("inbound"), F.concat(F.coalesce(F.concat(F.lit(" ("), F.nullif("relation", F.lit("")), F.lit(")")), F.lit("")), percent("stake_pct"))).when(
        F.col("predicate") == "OWNS_STAKE_IN",
        F.concat(F.coalesce(F.concat(F.lit(" ["), F.nullif("affiliation_type", F.lit("")), F.lit("]")), F.lit("")), percent("stake_pct"))
    ).when(F.col("predicate").isin("HAS_SEGMENT", "EXPOSED_TO"), percent("share_pct")).otherwise("")
    links = links.withColumn("line", F.concat(F.lit("- "), link, said))
    lines = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("other", "line")))), lambda x: x["line"])
    of = lambda predicate: (F.col("predicate") == predicate) & ~F.col("inbound")
    gathered = (links.repartition(parts, "company_id") if parts else links).groupBy("company_id").agg(
        lines(of("HAS_SEGMENT")).alias("segments"), lines(of("SELLS_TO")).alias("customers"), lines(of("EXPOSED_TO")).alias("regions"), lines(F.col("inbound")).alias("holders"), lines(of("OWNS_STAKE_IN")).alias("holdings"),
        F.min(F.when(of("IN_SECTOR"), F.coalesce("other_label", "other"))).alias("sector"), F.min(
            F.when(of("ISSUES_STOCK"), F.struct("other", F.col("attrs")["ticker"].alias("ticker"), F.col("attrs")["market"].alias("market")))
        ).alias("stock"),
    )
    found = issues.groupBy(F.col("subject").alias("company_id")).agg(F.count("*").alias("issues"))
    rows = nodes.filter("kind = 'company'").select(
        F.col("id").alias("company_id"), F.coalesce("label", "id").alias("label"), F.coalesce(F.col("attrs")["dart_code"], F.lit("")).alias("code")
    )
    rows = rows.join(gathered, "company_id", "left").join(financial_tables(facts, parts), "company_id", "left").join(found, "company_id", "left")
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, "\n")).otherwise(NONE_LINE)
    count = lambda c: F.size(F.coalesce(c, none)).cast("string")
    text_of = lambda c: text.yaml_string(F.coalesce(c, F.lit("")))
    note = F.concat_ws(
        "\n", F.lit('---\ntype: "company"'), F.concat(F.lit('dart_code: "'), "code", F.lit('"')), F.concat(F.lit("name: "), text_of("label")), F.concat(
            F.lit("ticker: "), text_of(F.col("stock.ticker"))
        ),
        F.concat(F.lit("market: "), text_of(F.col("stock.market"))), F.concat(F.lit("sector: "), text_of("sector")), F.concat(
            F.lit("periods: ["), F.array_join(F.coalesce("periods", none), ", "), F.lit("]")
        ),
        F.concat(F.lit("report_count: "), count("periods")), F.concat(F.lit("segment_count: "), count("segments")), F.concat(F.lit("customer_count: "), count("customers")),
        F.concat(F.lit("issue_count: "), F.coalesce("issues", F.lit(0)).cast("string")), F.lit("tags: [company]\n---"), F.concat(F.lit("# "), "label", F.lit("\n")),
        F.concat(
            F.lit("> 섹터: "), text.wikilink(F.col("sector")), F.lit("\n")
        ), F.lit("\n## 세그먼트\n"), listed("segments"), F.lit("\n## 고객사\n"), listed("customers"), F.lit("\n## 지역 노출\n"), listed("regions"),
        F.lit("\n## 지분구조\n\n### 주주 (최대주주·특수관계인)\n"), listed("holders"), F.lit("\n### 타법인 출자\n"), listed("holdings"), F.col("tables"),
    )
    return rows.select("company_id", text.note_name(F.col("label")).alias("name"), F.concat(note, F.lit("\n")).alias("note"))


def concept_notes(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("segment", "customer", "region", "sector")) -> DataFrame:
    """node_id, name, note: a note for each concept with the companies that lead to it, sorted and each once."""
    labels = nodes.filter("kind = 'company'").select(F.col("id").alias("subject_id"), F.coalesce("label", "id").alias("company"))
    last = latest_links(edges.filter(F.col("predicate").isin(*RELATION_LABELS))).join(labels, "subject_id")
    relation = F.create_map(*(F.lit(x) for pair in RELATION_LABELS.items() for x in pair))[F.col("predicate")]
    share = F.when(F.col("predicate").isin("HAS_SEGMENT", "EXPOSED_TO"), F.col("qualifier.share_pct"))
    line = F.concat(F.lit("- "), text.wikilink(F.col("company")), F.lit(" ("), relation, F.lit(")"), F.coalesce(F.concat(F.lit(" — "), text.general(share), F.lit("%")), F.lit("")))
    refs = last.groupBy(F.col("object_id").alias("id")).agg(
        F.count("*").alias("n"),
        F.transform(F.sort_array(F.collect_set(F.struct("company", relation.alias("r"), line.alias("line")))), lambda x: x["line"]).alias("lines")
    )
    rows = nodes.filter(F.col("kind").isin(*kinds)).select("id", "kind", F.coalesce("label", "id").alias("label")).join(refs, "id", "left")
    body = F.coalesce(F.array_join("lines", "\n"), F.lit("- (참조 없음)"))
    note = F.concat(
        F.lit('---\ntype: "'), "kind", F.lit('"\nname: '), text.yaml_string(F.col("label")), F.lit("\ntags: ["), "kind", F.lit("]\n---\n# "), "label",
        F.lit("\n\n\n## 이 "), "kind", F.lit("를 가리키는 회사 ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n\n"), body, F.lit("\n")
    )
    return rows.select(F.col("id").alias("node_id"), text.note_name(F.col("label")).alias("name"), note.alias("note"))


def person_notes(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """node_id, name, note: a note for each person with the companies that the person holds, sorted and each once, with the share last recorded.

    How a company is linked is made once a company. With `parts`, each shuffle of stakes goes over so many tasks.
    """
    company = F.coalesce("label", "id")
    labels = nodes.filter("kind = 'company'").select(F.col("id").alias("object_id"), company.alias("company"), text.wikilink(company).alias("link"))
    held = latest_links(edges.filter("predicate = 'OWNS_STAKE_IN'"), parts).join(labels, "object_id").select("subject_id", "company", "link", F.col("qualifier.stake_pct").alias("stake"))
    held = held.repartition(parts, "subject_id") if parts else held
    line = F.concat(F.lit("- "), "link", F.coalesce(F.concat(F.lit(" — "), text.general(F.col("stake")), F.lit("%")), F.lit("")))
    refs = held.groupBy(F.col("subject_id").alias("id")).agg(
        F.count("*").alias("n"), F.transform(F.sort_array(F.collect_set(F.struct("company", "stake", line.alias("line")))), lambda x: x["line"]).alias("lines")
    )
    rows = nodes.filter("kind = 'person'").select("id", F.coalesce("label", "id").alias("label")).join(refs, "id", "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    note = F.concat(
        F.lit('---\ntype: "person"\nname: '), text.yaml_string(F.col("label")), F.lit("\nowned_count: "), n, F.lit("\ntags: [person]\n---\n# "), "label",
        F.lit("\n\n\n## 보유 회사 ("), n, F.lit(")\n\n"), F.coalesce(F.array_join("lines", "\n"), F.lit(NONE_LINE)), F.lit("\n")
    )
    return rows.select(F.col("id").alias("node_id"), text.note_name(F.col("label")).alias("name"), note.alias("note"))


# The folders of a vault by the kind of a note's node.
NOTE_FOLDERS = {"company": "companies", "segment": "segments", "customer": "customers", "region": "regions", "sector": "sectors", "person": "people"}


def note_files(notes: DataFrame) -> DataFrame:
    """folder, name, note from notes (kind, node_id, name, note): no two files of a folder have one name, letter case aside.

    Of notes that clash, the one of the least id keeps its name; the others, and notes whose name says nothing, get a
    hash of their id behind it. Names are settled by an aggregation and a join, so a name that many share is no one's task.
    """
    folder = F.create_map(*(F.lit(x) for pair in NOTE_FOLDERS.items() for x in pair))[F.col("kind")]
    bare = F.coalesce(F.trim("name"), F.lit(""))
    rows = notes.select(folder.alias("folder"), "node_id", F.when(bare.rlike(r"^\.*$"), "").otherwise(bare).alias("name"), "note").withColumn("folded", F.lower("name"))
    first = rows.groupBy("folder", "folded").agg(F.min("node_id").alias("first"))
    own = (F.col("node_id") == F.col("first")) & (F.col("name") != "")
    hashed = F.trim(F.concat_ws(" ", "name", F.substring(F.sha1(F.col("node_id").cast("binary")), 1, 12)))
    return rows.join(first, ["folder", "folded"]).select("folder", F.when(own, F.col("name")).otherwise(hashed).alias("name"), "note")


def vault_notes(nodes: DataFrame, edges: DataFrame, facts: DataFrame, issues: DataFrame) -> DataFrame:
    """kind, node_id, name, note: the notes of companies, concepts and persons, as `note_files` takes them."""
    named = lambda df, node_id: df.select(F.substring_index(node_id, ":", 1).alias("kind"), F.col(node_id).alias("node_id"), "name", "note")
    return union(
        named(company_notes(nodes, edges, facts, issues), "company_id"), named(concept_notes(nodes, edges), "node_id"), named(person_notes(nodes, edges), "node_id")
    )
