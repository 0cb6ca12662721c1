"""The case table: small inputs with known answers."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import normalize, text
from ledgerloom.operators import graph_query, ingest, integrity, operations, sections, upsert
from ledgerloom.sources import sinks


def edges(spark, rows):
    """rows: subject, predicate, object, period, share, stake, is_largest"""
    flat = spark.createDataFrame(rows, "subject_id string, predicate string, object_id string, period string, share_pct double, stake_pct double, is_largest boolean")
    return flat.select("subject_id", "predicate", "object_id", "period", F.struct("share_pct", "stake_pct", "is_largest").alias("qualifier"))


def facts(spark, rows):
    return spark.createDataFrame(
        [(*r[:5], Decimal(r[5])) for r in rows],
        "company_id string, bsns_year string, fiscal_period string, fs_div string, metric_key string, amount decimal(22,2)"
    )


def test_screen(spark):
    nodes = spark.createDataFrame(
        [("A", "company", "a"), ("B", "company", "b"), ("C", "company", "c"), ("segment:hbm", "segment", "HBM"), ("segment:x", "segment", "X")],
        "id string, kind string, label string"
    )
    aliases = spark.createDataFrame([("hbm", "segment:hbm")], "alias_norm string, node_id string")
    e = edges(
        spark,
        [
            ("A", "HAS_SEGMENT", "segment:hbm", "2024", 60.0, None, None), ("A", "HAS_SEGMENT", "segment:x", "2024", None, None, None),
            ("B", "HAS_SEGMENT", "segment:hbm", "2024", 70.0, None, None), ("C", "HAS_SEGMENT", "segment:hbm", "2024", 20.0, None, None),
            ("C", "HAS_SEGMENT", "segment:x", "2024", 80.0, None, None)
        ]
    )
    amounts = {"A": (10, 20, 30), "B": (-5, 5, 10), "C": (10, 10, 10)}
    f = facts(spark, [(c, "2024", p, "CFS", "operating_income", v) for c, vs in amounts.items() for p, v in zip(("H1", "Q3", "FY"), vs)])
    assert [r["company_id"] for r in graph_query.screen(nodes, e, f, aliases, "HBM", "2024H1").collect()] == ["A"]
    assert {r["company_id"]: r["segment_id"] for r in graph_query.primary_segment(e).collect()} == {"A": "segment:hbm", "B": "segment:hbm", "C": "segment:x"}


def test_holders(spark):
    e = edges(
        spark,
        [
            ("p1", "OWNS_STAKE_IN", "A", "2023", None, 5.0, True), ("p2", "OWNS_STAKE_IN", "A", "2023", None, 8.0, False),
            ("p3", "OWNS_STAKE_IN", "A", "2023", None, None, False), ("p1", "OWNS_STAKE_IN", "A", "2022", None, 2.5, True)
        ]
    )
    assert [r["holder_id"] for r in graph_query.largest_shareholders(e).orderBy("place").collect()] == ["p2", "p1", "p3"]
    assert [(r["holder_id"], r["delta"]) for r in graph_query.stake_changes(e).collect()] == [("p1", 2.5)]


def test_integrity(spark):
    f = facts(
        spark,
        [("A", "2024", "FY", "CFS", "assets", 100), ("A", "2024", "H1", "CFS", "assets", 100), ("A", "2024", "Q1", "CFS", "assets", 95), ("Z", "2024", "FY", "CFS", "equity", 0)]
    )
    nodes = spark.createDataFrame([("A", "company", {"dart_code": "1"}), ("B", "company", {"dart_code": "2"})], "id string, kind string, attrs map<string,string>")
    e = edges(
        spark,
        [("x", "OWNS_STAKE_IN", "A", None, None, 70.0, True), ("y", "OWNS_STAKE_IN", "A", None, None, 60.0, True), ("x", "OWNS_STAKE_IN", "A", None, None, 70.0, False)]
    )
    found = {(r["code"], r["severity"], r["subject"]) for r in integrity.check_integrity(nodes, e, f).collect()}
    assert found == {("interim_bs_equals_fy", "error", "A"), ("duplicate_edge", "error", "x"), ("orphan_fact", "warn", "Z"), ("negative_or_zero_equity", "info", "Z")}
    row = integrity.verify_ownership(nodes, e).first()
    assert (row["coverage"], row["overstake_companies"], row["ok"]) == (0.5, 1, False)
    assert integrity.coverage(nodes.filter("false"), e).first()["coverage"] == 0


def test_statements(spark):
    raw = [
        ("2024", "IS", "ifrs-full_Revenue", "", "3", "2", "1", "CFS"), ("2024", "BS", "ifrs-full_Equity", "", "9", "8", "7", "CFS"),
        ("2024", "SCE", "ifrs-full_Equity", "", "5", "5", "5", "CFS"), ("2024", "CF", "", "당기순이익", "4", "4", "4", "CFS"),
        ("2024", "CIS", "", "당기순이익", "-5,000", "", "-", "CFS"), ("2024", "IS", "x", "매출총이익", "1", "1", "1", "CFS")
    ]
    rows = spark.createDataFrame(
        raw,
        "bsns_year string, sj_div string, account_id string, account_nm string, thstrm_amount string, frmtrm_amount string, bfefrmtrm_amount string, fs_div string"
    )
    got = {(r["metric_key"], r["bsns_year"], float(r["amount"])) for r in ingest.parse_statements(rows, F.lit("11011"), F.lit("1")).collect()}
    assert got == {("revenue", "2024", 3), ("revenue", "2023", 2), ("revenue", "2022", 1), ("equity", "2024", 9), ("net_income", "2024", -5000)}


def test_holder_rows(spark):
    rows = spark.createDataFrame(
        [(1, "홍길동", "본인", "10.5", "100"), (2, "홍길동", "본인", "12.5%", "1,000"), (3, "계", "", "100", "1"), (4, "현대투자", "계열회사", "-", "")],
        "ordinal long, nm string, relate string, trmend_posesn_stock_qota_rt string, trmend_posesn_stock_co string"
    )
    got = {(r["subject_id"], r["stake_pct"], r["shares"], r["is_largest"]) for r in ingest.holder_edges(rows, F.lit("00000001"), F.lit("2024")).collect()}
    assert got == {("person:00000001:홍길동", 12.5, 1000, True), ("company:ext:현대투자", None, None, False)}


def test_upsert_is_idempotent_and_null_safe(spark):
    kind = "subject_id string, predicate string, object_id string, period string, v int, extracted_at string"
    current = spark.createDataFrame([("a", "P", "b", None, 1, "old"), ("a", "P", "b", "2024", 2, "old")], kind)
    batch = spark.createDataFrame([("a", "P", "b", None, 5, "new"), ("a", "P", "b", None, 6, "new"), ("c", "P", "d", None, 7, "new")], kind)
    once = upsert.upsert_edges(current, batch, [F.desc("v")])
    twice = upsert.upsert_edges(once, batch, [F.desc("v")])
    rows = sorted(map(tuple, once.collect()), key=repr)
    assert rows == sorted(map(tuple, twice.collect()), key=repr)
    assert ("a", "P", "b", None, 6, "old") in rows and ("c", "P", "d", None, 7, "new") in rows and len(rows) == 3


def test_repoint_merges_conflicts(spark):
    e = spark.createDataFrame(
        [("s", "SELLS_TO", "customer:raw", "2024", 1), ("s", "SELLS_TO", "company:1", "2024", 2), ("s", "SELLS_TO", "customer:raw", "2023", 3)],
        "subject_id string, predicate string, object_id string, period string, id int"
    )
    mapping = spark.createDataFrame([("customer:raw", "company:1")], "old_id string, new_id string")
    assert sorted(map(tuple, upsert.repoint(e, mapping, "object_id", [F.col("id")]).collect())) == [
        ("s", "SELLS_TO", "company:1", "2023", 3), ("s", "SELLS_TO", "company:1", "2024", 2)
    ]


def test_customer_aliases_do_not_fall_back(spark):
    nodes = spark.createDataFrame(
        [("company:1", "company", "현대"), ("customer:a", "customer", "현대(주)"), ("customer:b", "customer", "모름"), ("customer:c", "customer", "현대 주식회사")],
        "id string, kind string, label string"
    )
    aliases = spark.createDataFrame([("현대 주식회사", "company:gone")], "alias_norm string, node_id string")
    got = upsert.customer_mapping(nodes, aliases, normalize.normalize_alias(F.col("label")), normalize.normalize_corp_name(F.col("label")))
    assert [tuple(r) for r in got.collect()] == [("customer:a", "company:1")]


def test_sections(spark):
    body = "가" * 400
    lines = lambda *x: list(x)
    docs = spark.createDataFrame(
        [
            (1, lines("1. 사업의 개요", body, "2. 주요 제품", body, "3. 매출", body)),
            (2, lines("1. 사업의 개요", "short", "2. 주요 제품", body)),
            (3, lines("no headers", body)),
            (4, lines("1. 사업의 개요", body, "2. 알 수 없음", body)),
        ],
        "doc long, lines array<string>",
    )
    got = {r["doc"]: r for r in sections.sections(docs, "doc", F.col("lines")).collect()}
    assert [got[i]["level"] for i in (1, 2, 3, 4)] == ["regex", "full_text", "full_text", "regex"]
    assert got[1]["output"].startswith("## 사업의 개요\n") and got[1]["skipped"] == []
    assert got[2]["invalid"] == ["overview"] and got[4]["skipped"] == ["products", "revenue"]
    answers = spark.createDataFrame([(4, "products", 1), (4, "revenue", 9)], "doc long, target string, choice int")
    asked = {r["doc"]: r for r in sections.sections(docs, "doc", F.col("lines"), fallback=answers).collect()}
    assert asked[4]["level"] == "regex+llm" and asked[4]["skipped"] == ["revenue"]


def test_queue_and_lifecycle(spark):
    q = spark.createDataFrame([(i, "pending") for i in range(5)], "id long, status string")
    assert operations.queue_next(q, 4).count() == 4
    had = spark.createDataFrame([("1", None), ("2", "2024-01-01"), ("3", None)], "ticker string, d string").select("ticker", F.col("d").cast("date").alias("delisted_at"))
    both = operations.listing(spark.createDataFrame([("1",), ("2",), ("4",)], "ticker string"), spark.createDataFrame([("4",), ("5",)], "ticker string"))
    assert dict(map(tuple, both.collect()))["4"] == "KOSDAQ"
    got = dict(map(tuple, operations.lifecycle(had, both, spark.createDataFrame([("1",), ("2",), ("4",)], "ticker string")).collect()))
    assert got == {"1": "updated", "2": "relisted", "3": "delisted", "4": "added", "5": "unlinked"}
    status, attempts = operations.transition(F.col("a"), F.col("o"), F.col("m"))
    rows = spark.createDataFrame(
        [(0, "ok", ""), (1, "fetch_error", "x"), (2, "fetch_error", "x"), (0, "extract_error", "x"), (0, "fetch_error", "no report")],
        "a int, o string, m string"
    )
    assert [r[0] for r in rows.select(status).collect()] == ["done", "pending", "failed", "failed", "skipped"]
    years = spark.createDataFrame([("A", 2019), ("B", 2020)], "corp string, year int")
    assert dict(map(tuple, operations.years_with_floor(years, "corp", 2026, 3).collect())) == {"A": [2019, 2024, 2025, 2026], "B": [2020, 2024, 2025, 2026]}


def test_pattern_store_and_validation(spark):
    fields = "target string, regex string, samples array<string>, confirmed_count int, source string, ordinal int"
    baseline = spark.createDataFrame([("overview", "사업.{0,3}개요", [], 0, "code_baseline", 0)], fields)
    stored = spark.createDataFrame([("overview", "회사.{0,3}소개", ["회사의 소개"], 4, "learned", 1), ("revenue", "old", [], 1, "code_baseline", 2)], fields)
    known = {(r["target"], r["regex"], r["source"]) for r in sections.known_patterns(baseline, stored).collect()}
    assert known == {("overview", "사업.{0,3}개요", "code_baseline"), ("overview", "회사.{0,3}소개", "learned")}
    assert sections.pattern_problem("overview", "회사") is None
    assert "unknown" in sections.pattern_problem("people", "x") and "no regular" in sections.pattern_problem("overview", "(") and "everything" in sections.pattern_problem("overview", "x*")
    seen = [("overview", "개요", i, False) for i in range(3)] + [("overview", "매출", i, False) for i in range(3)] + [("products", "제품", 1, False)]
    observed = spark.createDataFrame(seen, "target string, regex string, at int, refuted boolean").withColumn("header", F.col("regex"))
    fixtures = spark.createDataFrame([("overview", "사업의 개요"), ("revenue", "매출 및 수주"), ("products", "주요 제품")], "target string, header string")
    judged = {(r["target"], r["regex"]): (r["promoted"], r["tag"]) for r in sections.validate_proposals(sections.promote_proposals(observed), fixtures).collect()}
    assert judged == {("overview", "개요"): (True, None), ("overview", "매출"): (False, "__rejected_by:revenue"), ("products", "제품"): (False, None)}


def test_publish_checked(spark, tmp_path):
    good = spark.createDataFrame([(1,)], "x int")
    bad = spark.createDataFrame([(-1,)], "x int")
    negative = lambda df: df.filter("x < 0")
    assert sinks.publish_checked(good, f"{tmp_path}/stage", f"{tmp_path}/out", negative).isEmpty()
    assert sinks.publish_checked(bad, f"{tmp_path}/stage", f"{tmp_path}/out", negative).count() == 1
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
    (tmp_path / "m.zip").write_text("x")
    assert sinks.is_fresh(spark, f"{tmp_path}/m.zip", 1) and not sinks.is_fresh(spark, f"{tmp_path}/m.zip", 0)


def test_resolution_marks_and_drops(spark):
    nodes = spark.createDataFrame([("customer:a", "customer", "A", {"k": "v"}), ("customer:b", "customer", "B", None), ("company:1", "company", "A", None)], "id string, kind string, label string, attrs map<string,string>")
    mapping = spark.createDataFrame([("customer:a", "company:1")], "old_id string, new_id string")
    got = {r["id"]: r["attrs"] for r in upsert.mark_unresolved(nodes, mapping).collect()}
    assert got == {"customer:a": {"k": "v"}, "customer:b": {"resolved": "false"}, "company:1": None}
    assert {r["id"] for r in upsert.drop_nodes(nodes, mapping).collect()} == {"customer:b", "company:1"}
    sales = edges(spark, [("company:2", "SELLS_TO", "customer:a", "2024", 1.0, None, None)]).withColumn("qualifier", F.col("qualifier").withField("buyer_raw", F.lit(None).cast("string")))
    moved = upsert.repoint(sales, mapping, "object_id", [F.col("period")], buyer_raw=F.lit("A")).first()
    assert moved["object_id"] == "company:1" and moved["qualifier"]["buyer_raw"] == "A"


def test_content_lines(spark):
    page = "<h1>1. 개요</h1><script>no</script><table><tr><td>a</td><td> b </td></tr></table>\n<p> c\n\n d</p>"
    assert spark.createDataFrame([(page,)], "h string").select(text.content_lines(F.col("h"))).first()[0] == ["1. 개요", "a", "b", "c", " d"]


def test_closure_of_circles_and_hubs(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), *((f"h{i}", "a") for i in range(20))]
    edges = spark.createDataFrame([(x, "OWNS_STAKE_IN", y, "2023", (1.0, False)) for x, y in pairs], "subject_id string, predicate string, object_id string, period string, qualifier struct<stake_pct: double, is_largest: boolean>")
    want, front = {p: 1 for p in pairs}, list(pairs)
    for hops in range(2, 7):
        front = [(x, z) for x, y in front for y2, z in pairs if y == y2 and (x, z) not in want]
        want |= {p: hops for p in front}
    for rounds in (1, 2, 3, 6):
        got = {(r["holder_id"], r["company_id"]): r["hops"] for r in graph_query.ownership_closure(edges, rounds).collect()}
        assert got == {p: n for p, n in want.items() if n <= rounds}


def test_summary_of_unknown_shares_and_enumerated_targets(spark):
    rows = [("c", "HAS_SEGMENT", f"segment:{i}", "2023", (None if i == 0 else float(i),)) for i in range(7)] + [("c", "SELLS_TO", f"customer:{i}", "2023", (5.0,)) for i in range(7)]
    rows += [("c", "HAS_SEGMENT", "segment:old", "2022", (99.0,)), ("d", "EXPOSED_TO", "region:KR", None, (None,)), ("c", "IN_SECTOR", "sector:1", "2024", (None,))]
    edges = spark.createDataFrame(rows, "subject_id string, predicate string, object_id string, period string, qualifier struct<share_pct: double>")
    got = {}
    for r in graph_query.company_summary(edges).orderBy("company_id", "predicate", "place").collect():
        got.setdefault((r["company_id"], r["predicate"]), []).append(r["object_id"])
    assert got == {
        ("c", "HAS_SEGMENT"): [f"segment:{i}" for i in (6, 5, 4, 3, 2, 1, 0)], ("c", "SELLS_TO"): [f"customer:{i}" for i in range(5)], ("d", "EXPOSED_TO"): ["region:KR"]
    }
    codes = spark.createDataFrame([("1",), ("1",), ("2",)], "corp_code string")
    assert sorted(map(tuple, operations.enumerate_targets(codes, "2021, 2023,2021,").collect())) == [("1", "2021"), ("1", "2023"), ("2", "2021"), ("2", "2023")]


def test_integrity_in_one_pass_keeps_nulls_and_repeated_rows(spark):
    f = spark.createDataFrame([
        ("c", "2023", "H1", "CFS", "equity", -1), ("c", "2023", "FY", "CFS", "equity", -1), ("c", "2023", "FY", "CFS", "equity", -1),
        ("c", "2023", None, "CFS", "equity", -1), ("c", "2023", "Q1", "CFS", "equity", None), (None, "2022", "FY", "CFS", "revenue", 1),
    ], "company_id string, bsns_year string, fiscal_period string, fs_div string, metric_key string, amount long")
    nodes = spark.createDataFrame([("c",), (None,), ("unused",)], "id string")
    e = spark.createDataFrame([], "subject_id string, predicate string, object_id string, period string")
    found = sorted((r["code"], r["subject"] or "", r["detail"]) for r in integrity.check_integrity(nodes, e, f, ("equity",)).collect())
    low = "negative_or_zero_equity"
    assert found == sorted([
        ("interim_bs_equals_fy", "c", "2023 equity H1 CFS"), (low, "c", "2023 H1"), (low, "c", "2023 FY"), (low, "c", "2023 FY"), (low, "c", "2023 -"),
        ("orphan_fact", "", ""),
    ])
    assert integrity.check_integrity(nodes, e, f.limit(0)).count() == 0
