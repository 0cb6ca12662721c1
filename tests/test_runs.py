"""End-to-end runs over landed answers."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import text
from ledgerloom.operators import extraction, graph_query, upsert
from ledgerloom.plans import runs
from ledgerloom.sources import landing, vault


def land(root, kind, code, year, report, rows, status="000"):
    folder = root / kind / f"corp_code={code}" / f"bsns_year={year}" / f"reprt_code={report}"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"status": status, "message": "", "list": rows}))


@pytest.fixture
def landed(spark, tmp_path):
    account = lambda div, sj, name, *amounts: dict(
        zip(("fs_div", "sj_div", "account_id", "account_nm", "thstrm_amount", "frmtrm_amount", "bfefrmtrm_amount"), (div, sj, "", name, *amounts))
    )
    land(
        tmp_path, "statements", "00000007", "2025", "11011",
        [account("OFS", "IS", "매출액", "1", "1", "1"), account("CFS", "IS", "매출액", "30", "20", "10"), account("CFS", "BS", "자산총계", "9", "8", "7")]
    )
    land(tmp_path, "statements", "00000007", "2026", "11012", [account("OFS", "BS", "자산총계", "5,000", "-", "")])
    land(tmp_path, "statements", "00000007", "2019", "11011", [account("CFS", "IS", "매출액", "3", "2", "1")])
    land(tmp_path, "statements", "00000008", "2025", "11011", [], "013")
    land(tmp_path, "statements", "00000009", "2025", "11011", [account("CFS", "IS", "매출액", "1", "1", "1")])  # not in the register
    land(tmp_path, "shares", "00000007", "2025", "11011", [{"se": "합계", "istc_totqy": "9"}, {"se": " 보통주", "istc_totqy": "1,234"}, {"se": "보통주", "istc_totqy": "5"}])
    land(
        tmp_path, "holders", "00000007", "2025", "11011",
        [
            {"nm": "홍길동", "relate": "본인", "trmend_posesn_stock_co": "10", "trmend_posesn_stock_qota_rt": "1.5"},
            {"nm": "홍길동", "relate": "본인", "trmend_posesn_stock_co": "20", "trmend_posesn_stock_qota_rt": "12.5"},
            {"nm": "합계", "relate": "", "trmend_posesn_stock_co": "30", "trmend_posesn_stock_qota_rt": "14"}
        ]
    )
    land(tmp_path, "investments", "00000007", "2025", "11011", [{"inv_prm": "(주)갑", "invstmnt_purps": "경영참여", "trmend_blce_qy": "7", "trmend_blce_qota_rt": "51"}])
    land(tmp_path, "investments", "00000008", "2025", "11011", [], "800")
    read = {"statements": landing.report_statements, "shares": landing.share_counts, "holders": landing.largest_shareholders, "investments": landing.other_investments}
    return {k: f(spark, str(tmp_path / k)) for k, f in read.items()}


@pytest.fixture
def tables(spark):
    nodes = spark.createDataFrame(
        [
            ("company:00000007", "company", "Seven", {"dart_code": "00000007"}), ("company:00000008", "company", "Eight", {"dart_code": "00000008"}),
            ("company:ext:갑", "company", "Gap", {"external": "true", "seen": "1"})
        ],
        schema.NODES
    )
    edges = spark.createDataFrame(
        [("company:00000007", "HAS_SEGMENT", "segment:x", p) for p in ("2019", "2020H1")],
        "subject_id string, predicate string, object_id string, period string"
    )
    rest = spark.createDataFrame([], schema.EDGES)
    edges = edges.unionByName(rest, allowMissingColumns=True).select(*rest.columns)
    return {"nodes": nodes, "edges": edges, "facts": spark.createDataFrame([], schema.FACTS)}


def test_targets(tables):
    got = {tuple(r) for r in runs.targets(tables["nodes"], tables["edges"], ("11011", "11012"), 2026).collect()}
    years = {"00000007": ("2019", "2024", "2025", "2026"), "00000008": ("2024", "2025", "2026")}
    assert got == {(c, y, r) for c, ys in years.items() for y in ys for r in ("11011", "11012")}
    assert {tuple(r) for r in runs.targets(tables["nodes"], tables["edges"], ("11011",), 2026, years=["2001"]).collect()} == {(c, "2001", "11011") for c in years}


FACTS = {
    ("revenue", "2025", "FY", "CFS", 30), ("revenue", "2024", "FY", "CFS", 20), ("revenue", "2023", "FY", "CFS", 10),
    ("revenue", "2019", "FY", "CFS", 3), ("revenue", "2018", "FY", "CFS", 2), ("revenue", "2017", "FY", "CFS", 1), ("assets", "2025", "FY", "CFS", 9),
    ("assets", "2026", "H1", "OFS", 5000), ("shares_outstanding", "2025", "FY", "CFS", 1234)
}


def flat(facts):
    return {(r["metric_key"], r["bsns_year"], r["fiscal_period"], r["fs_div"], int(r["amount"])) for r in facts.collect()}


def test_financials(tables, landed):
    facts = runs.ingest_financials(tables["nodes"], tables["edges"], tables["facts"], landed["statements"], landed["shares"], 2026)
    assert flat(facts) == FACTS and {r["company_id"] for r in facts.collect()} == {"company:00000007"}
    again = runs.ingest_financials(tables["nodes"], tables["edges"], facts, landed["statements"], landed["shares"], 2026)
    assert flat(again) == FACTS and again.count() == len(FACTS)
    stale = facts.withColumn("bsns_year", F.lit("1990"))
    fresh, issues = runs.rebuild_financials(tables["nodes"], tables["edges"], stale, landed["statements"], landed["shares"], 2026)
    assert flat(fresh) == FACTS and issues.collect() == []


def test_equity(tables, landed):
    nodes, edges = runs.ingest_equity(tables["nodes"], tables["edges"], landed["holders"], landed["investments"], 2026)
    own = {(r["subject_id"], r["object_id"], r["period"], r["qualifier"]["stake_pct"], r["source_ref"]) for r in edges.filter("predicate = 'OWNS_STAKE_IN'").collect()}
    assert own == {
        ("person:00000007:홍길동", "company:00000007", "2025", 12.5, "dart:00000007:2025:11011"),
        ("company:00000007", "company:ext:주-갑", "2025", 51.0, "dart:00000007:2025:11011")
    }
    by_id = {r["id"]: r for r in nodes.collect()}
    assert by_id["company:ext:주-갑"]["attrs"] == {"external": "true"} and by_id["person:00000007:홍길동"]["kind"] == "person"
    assert by_id["company:00000007"]["attrs"] == {"dart_code": "00000007"} and edges.count() == 4
    nodes2, edges2 = runs.ingest_equity(nodes, edges, landed["holders"], landed["investments"], 2026)
    assert edges2.count() == edges.count() and nodes2.count() == nodes.count()


def test_pipeline(spark, tables, landed):
    record = ("2024", [("HBM", 60.0, None, [])], [("Big Co", 10.0, "1차")], [("KR", 40.0)])
    extractions = spark.createDataFrame(
        [("00000007", "r1", record), ("00000008", "r2", ("2024", [("X", 160.0, None, [])], [], []))],
        f"company_code string, rcept_no string, record {schema.EXTRACTION}"
    )
    done = runs.run_pipeline(tables, landed | {"extractions": extractions}, 2026)
    assert done.ran == ["structure", "financials", "equity", "export"] and done.skipped == []
    kinds = {r["predicate"]: r["count"] for r in done.tables["export"].groupBy("predicate").count().collect()}
    assert kinds == {"HAS_SEGMENT": 3, "SELLS_TO": 1, "EXPOSED_TO": 1, "OWNS_STAKE_IN": 2, "REPORTS": len(FACTS)}
    again = runs.run_pipeline(done.tables, landed | {"extractions": extractions}, 2026, skip=("financials", "export"))
    assert again.skipped == ["financials", "export"] and again.tables["edges"].count() == done.tables["edges"].count()


def test_page_text(spark):
    page = "<html><style>x</style><h1> 1. 사업의  개요 </h1><p>a&amp;b&nbsp;</p><!-- <p>no</p> --><table><tr><th>구분</th><th> 비중 </th></tr><tr><td></td><td> </td></tr><tr><td>가 <b>나</b></td><td>&#49;0%</td></tr></table><div>끝<br>줄\n  둘</div>"
    lines = spark.createDataFrame([(page,)], "h string").select(text.html_lines(F.col("h"))).first()[0]
    assert lines == ["1. 사업의  개요", "a&b", "구분\t비중", "가나\t10%", "끝", "줄", "  둘"]


def records(spark, *rows):
    return spark.createDataFrame(
        [(code, no, (period, [(name, share, None, [])], [("Big Co", 10.0, "1차")], [("KR", 40.0)])) for code, no, period, name, share in rows],
        f"company_code string, rcept_no string, record {schema.EXTRACTION}"
    )


def held(run):
    edges = run.tables["edges"].filter("predicate = 'HAS_SEGMENT' and source_ref is not null")
    return sorted((r["object_id"], r["period"], r["source_ref"], r["qualifier"]["share_pct"]) for r in edges.collect())


def test_structure_rejects_a_record_not_its_company(spark, tables, landed):
    said = records(spark, ("00000007", "r1", "2022", "chips", 50.0), ("00000007", "r2", "2023", "chips", 150.0))
    done = runs.run_pipeline(tables, landed | {"extractions": said}, 2026, skip=("financials", "equity", "export"))
    assert held(done) == [("segment:00000007:chips", "2022", "r1", 50.0)]


def test_structure_of_two_reports_of_a_period(spark, tables, landed):
    said = records(spark, ("00000007", "r1", "2024", "chips", 50.0), ("00000007", "r2", "2024", "chips", 60.0))
    rest = ("financials", "equity", "export")
    done = runs.run_pipeline(tables, landed | {"extractions": said}, 2026, skip=rest)
    want = [("segment:00000007:chips", "2024", "r2", 60.0)]
    assert held(done) == want
    for _ in range(2):  # r1 is on record though no edge tells of it
        done = runs.run_pipeline(done.tables, landed | {"extractions": said}, 2026, skip=rest)
        assert held(done) == want and sorted(r["rcept_no"] for r in done.tables["reports"].collect()) == ["r1", "r2"]


def test_structure_makes_nodes_with_their_provenance(spark, tables, landed):
    said = records(spark, ("00000007", "r1", "2024", "HBM 메모리", 50.0), ("00000123", "r2", "2024", "Chips", None))
    seven = tables["nodes"].unionByName(spark.createDataFrame([("region:KR", "region", "Korea", None)], schema.NODES))
    master = spark.createDataFrame([("00000123", "One Two Three")], "corp_code string, corp_name string")
    done = runs.run_pipeline(tables | {"nodes": seven}, landed | {"extractions": said, "master": master}, 2026, skip=("equity", "export"))
    nodes = {r["id"]: r for r in done.tables["nodes"].collect()}
    assert nodes["segment:00000007:hbm-메모리"]["attrs"] == {"company": "00000007", "name": "HBM 메모리"} and nodes["customer:big-co"]["label"] == "Big Co"
    assert nodes["region:KR"]["label"] == "Korea" and nodes["company:00000123"]["label"] == "One Two Three" and nodes["company:00000007"]["label"] == "Seven"
    assert nodes["metric:revenue"]["kind"] == "metric" and nodes["period:2025FY"]["label"] == "2025 FY"
    new = done.tables["edges"].filter("source_ref is not null").collect()
    assert {(r["source_type"], r["method"], r["confidence"]) for r in new} == {("llm", "llm", 0.9)} and len(new) == 6
    assert {r["object_id"] for r in new} | {r["subject_id"] for r in new} <= set(nodes)
    hit = graph_query.resolve_concept(done.tables["nodes"], spark.createDataFrame([], schema.ALIASES), "hbm 메모리", "segment")
    assert [r[0] for r in hit.collect()] == ["segment:00000007:hbm-메모리"]


def test_pipeline_exports_nodes_and_notes(spark, tables, landed, tmp_path):
    done = runs.run_pipeline(tables, landed | {"extractions": records(spark, ("00000007", "r1", "2024", "chips", 50.0))}, 2026)
    assert done.tables["export_nodes"].count() == done.tables["nodes"].count()
    notes = {r["company_id"]: r["note"] for r in done.tables["export_notes"].collect()}
    assert "chips" in notes["company:00000007"] and "company:00000008" in notes
    assert any("Seven" in r["note"] for r in done.tables["export_concepts"].collect() if r["node_id"] == "segment:00000007:chips")
    assert {r["node_id"] for r in done.tables["export_people"].collect()} == {r["id"] for r in done.tables["nodes"].filter("kind = 'person'").collect()} != set()
    vault.write_notes(done.tables["export_files"], str(tmp_path))
    folder, n = vault.current_notes(str(tmp_path))
    assert n == sum(done.tables[f"export_{k}"].count() for k in ("notes", "concepts", "people")) and "chips" in open(f"{folder}/companies/Seven.md").read()


GOOD = {"period": "2024", "segments": [{"name_ko": "가", "share_pct": "약 12.5%", "products": ["a"]}], "customers": [{"name_raw": "Co"}], "geographic": [{"region_code": "KR", "share_pct": 7}, {"region_code": "XX", "share_pct": None}, 3]}


def changed(**by):
    return json.dumps(GOOD | by, ensure_ascii=False)


ANSWERS = {
    json.dumps(GOOD, ensure_ascii=False): [],
    f"Here it is:\n```json\n{json.dumps(GOOD, ensure_ascii=False)}\n```\nDone.": [],
    "no record": [("$", "json")], "```json\n{broken}\n```": [("$", "json")], "": [("$", "json")], None: [("$", "json")], "[1]": [("$", "type")], "3": [("$", "type")],
    "{}": [(f"$.{k}", "missing") for k in ("period", "segments", "customers", "geographic")],
    changed(b=1, a=2): [("$.a", "extra"), ("$.b", "extra")],
    changed(period=2024): [("$.period", "type")], changed(period=None): [("$.period", "type")],
    changed(segments={}): [("$.segments", "type")], changed(customers=None): [("$.customers", "type")],
    changed(segments=[{"share_pct": 101, "note": "x"}, "text", {"name_ko": "b", "share_pct": "many"}]): [
        ("$.segments[0].note", "extra"), ("$.segments[0].name_ko", "missing"), ("$.segments[0].share_pct", "range"), ("$.segments[1]", "type"), ("$.segments[2].share_pct", "number")
    ],
    changed(segments=[{"name_ko": "b", "share_pct": None, "description": None}]): [],
    changed(segments=[{"name_ko": None, "share_pct": [1], "description": 4, "products": ["x", 1]}]): [
        ("$.segments[0].name_ko", "type"), ("$.segments[0].share_pct", "type"), ("$.segments[0].description", "type"), ("$.segments[0].products", "type")
    ],
    changed(segments=[{"name_ko": "b", "products": None}]): [("$.segments[0].products", "type")],
    changed(customers=[{"name_raw": "x", "tier": "3차", "revenue_share_pct": -1}]): [("$.customers[0].revenue_share_pct", "range"), ("$.customers[0].tier", "choice")],
    changed(customers=[{"name_raw": "x", "tier": None}]): [("$.customers[0].tier", "type")],
    changed(geographic=[{"region_code": "ZZ", "share_pct": 1}, {"share_pct": True, "region_code": "US"}]): [("$.geographic[0].region_code", "choice")],
}


def test_answers_become_records(spark):
    frame = spark.createDataFrame(list(enumerate(ANSWERS)), "id long, answer string")
    parsed = extraction.parse_answers(frame).collect()
    assert {ANSWERS_AT[r["id"]]: [tuple(f) for f in r["faults"]] for r in parsed} == ANSWERS
    assert all((r["record"] is None) == bool(r["faults"]) for r in parsed)
    first = parsed[0]["record"].asDict(True)
    assert first == {
        "period": "2024", "segments": [{"name_ko": "가", "share_pct": 12.5, "description": None, "products": ["a"]}],
        "customers": [{"name_raw": "Co", "revenue_share_pct": None, "tier": "unknown"}], "geographic": [{"region_code": "KR", "share_pct": 7.0}]
    }
    last = next(r for r in parsed if "101" not in (r["answer"] or "") and '"US"' in (r["answer"] or ""))
    assert last["record"] is None
    rejected = extraction.rejects(extraction.parse_answers(frame), ["id"])
    assert rejected.count() == sum(map(len, ANSWERS.values()))


ANSWERS_AT = list(ANSWERS)


def test_extractor_seam_feeds_the_structure_run(spark, tables, landed):
    reports = spark.createDataFrame([("00000007", "r1", "text", "2024"), ("00000008", "r2", "text", "2024")], "company_code string, rcept_no string, text string, period string")
    answer = F.when(F.col("company_code") == "00000007", F.lit(json.dumps(GOOD, ensure_ascii=False))).otherwise(F.lit(changed(extra=1)))
    said, rejected = extraction.extract(reports, lambda r: r.withColumn("answer", answer))
    assert [tuple(r) for r in rejected.collect()] == [("00000008", "r2", "$.extra", "extra")]
    done = runs.run_pipeline(tables, landed | {"extractions": said}, 2026, skip=("financials", "equity", "export"))
    assert held(done) == [("segment:00000007:가", "2024", "r1", 12.5)]


def test_settled_follows_chains_and_names_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    pairs = chain + [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("in", "x"), ("self", "self"), ("one", "end")]
    mapping, cycles = upsert.settled(spark.createDataFrame(pairs, "old_id string, new_id string"))
    got = {r["old_id"]: r["new_id"] for r in mapping.collect()}
    assert got == {o: "c37" for o, _ in chain} | {"a": "c", "b": "c", "one": "end"}
    assert sorted(map(tuple, cycles.collect())) == [("in", "x"), ("x", "y"), ("y", "x")]
    assert upsert.settled(spark.createDataFrame([], "old_id string, new_id string"))[0].count() == 0


def test_resolve_leaves_no_edge_at_a_dropped_node(spark):
    nodes = spark.createDataFrame(
        [
            ("company:1", "company", "Big", {"dart_code": "1"}), ("company:2", "company", "Second Co., Ltd.", {"dart_code": "2"}), ("company:ext:big-inc", "company", "Big Inc.", {"external": "true"}),
            ("company:ext:two", "company", "Two", None), ("customer:big", "customer", "(주) Big", None), ("customer:who", "customer", "Who", None),
            ("segment:a", "segment", "A", None), ("segment:b", "segment", "B", None), ("segment:c", "segment", "C", None), ("segment:r", "segment", "R", None), ("segment:s", "segment", "S", None),
            ("person:1:kim", "person", "Kim", None), ("person:kim", "person", "Kim H", None)
        ],
        schema.NODES
    )
    rows = [
        ("company:1", "HAS_SEGMENT", "segment:a"), ("company:1", "HAS_SEGMENT", "segment:c"), ("company:2", "HAS_SEGMENT", "segment:r"), ("company:2", "SELLS_TO", "customer:big"),
        ("company:2", "SELLS_TO", "customer:who"), ("company:ext:big-inc", "OWNS_STAKE_IN", "company:ext:two"), ("person:1:kim", "OWNS_STAKE_IN", "company:1")
    ]
    empty = spark.createDataFrame([], schema.EDGES)
    edges = spark.createDataFrame([(*r, "2024", f"r{i}") for i, r in enumerate(rows)], "subject_id string, predicate string, object_id string, period string, source_ref string")
    edges = edges.unionByName(empty, allowMissingColumns=True).select(*empty.columns)
    aliases = spark.createDataFrame(
        [("a", "segment:b"), ("b", "segment:c"), ("r", "segment:s"), ("s", "segment:r"), ("kim", "person:kim"), ("two", "company:2")], "alias_norm string, node_id string"
    )
    after, moved, cycles = runs.resolve(nodes, edges, aliases)
    left = {r["id"]: r["attrs"] for r in after.collect()}
    assert set(left) == {"company:1", "company:2", "customer:who", "segment:c", "segment:r", "segment:s", "person:kim"} and left["customer:who"] == {"resolved": "false"}
    got = {(r["subject_id"], r["predicate"], r["object_id"]): r for r in moved.collect()}
    assert set(got) == {
        ("company:1", "HAS_SEGMENT", "segment:c"), ("company:2", "HAS_SEGMENT", "segment:r"), ("company:2", "SELLS_TO", "company:1"), ("company:2", "SELLS_TO", "customer:who"),
        ("company:1", "OWNS_STAKE_IN", "company:2"), ("person:kim", "OWNS_STAKE_IN", "company:1")
    }
    assert {x for s, _, o in got for x in (s, o)} <= set(left) and got["company:1", "HAS_SEGMENT", "segment:c"]["source_ref"] == "r1"
    assert got["company:2", "SELLS_TO", "company:1"]["qualifier"]["buyer_raw"] == "(주) Big" and len(cycles.collect()) == 2
