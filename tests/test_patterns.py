import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import patterns

HEADERS = ["사업의 개요", "주요 제품 등", "매출 및 수주", "a.b", "axb", "ab", "aab", "a*b", "tail\\end", "", "line\nbreak", "매출", "🙂smile🙂"]
REGEXES = [
    "사업.{0,3}개요", "제품|매출", "a\\.b", "a.b", "a?b", "ab+", "ab*$", "^a", "a\\*b", "a{2}b", "\\w+ 제품", "tail\\\\end", "[매]출", "(?i)AB", "매출", "a+?b", "수주$",
    "🙂smile", "line.break", "line\\nbreak", "x{0,2}매출", "매출\\.?",
]


def test_required_pieces(spark):
    cases = {
        "사업.{0,3}개요": ["사업", "개요"], "a\\.b": ["a.b"], "ab?c": ["a", "c"], "ab+c": ["ab", "c"], "a|b": [], "(ab)": [], "a\\db": [], "a{2,3}bc": ["bc"], "^ab$": ["ab"],
        "a\\*b": ["a*b"], "a\\.?b": ["a", "b"], "a\\\\b": [], "[ab]": [], "ab\\": [],
    }
    df = spark.createDataFrame([(r,) for r in cases], "regex string").select("regex", patterns.required_pieces(F.col("regex")).alias("pieces"))
    assert {r["regex"]: r["pieces"] for r in df.collect()} == cases


def test_matches_equal_brute_force(spark):
    rows = [("overview", r) for r in REGEXES] * 2 + [("revenue", "매출"), ("overview", "("), ("overview", "x*"), ("overview", None), (None, "매출"), ("people", "매출")]
    known = spark.createDataFrame(rows, "target string, regex string")
    texts = spark.createDataFrame([(h, i) for i, h in enumerate([*HEADERS, *HEADERS, None])], "header string, line int")
    want = {(h, "overview", r) for h in HEADERS for r in REGEXES if re.search(r, h, re.ASCII)} | {(h, "revenue", "매출") for h in HEADERS if "매출" in h}
    got = [tuple(r) for r in patterns.matches(known, texts).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in patterns.rejects(known).collect()} == {
        ("overview", "(", "no regular expression"), ("overview", "x*", "matches everything"), ("overview", None, "no regular expression"),
        (None, "매출", "unknown target null"), ("people", "매출", "unknown target people"),
    }
    assert patterns.matches(known.limit(0), texts).isEmpty() and patterns.matches(known, texts.limit(0)).isEmpty()


def test_patterns_with_literals_are_not_tried_on_all(spark):
    """A text is tried only on patterns whose key it holds: the plan's join is by key."""
    known = spark.createDataFrame([("overview", f"word{i}.{{0,3}}end{i}") for i in range(300)], "target string, regex string")
    texts = spark.createDataFrame([(f"1. word{i} end{i}",) for i in range(300)], "header string")
    found = patterns.matches(known, texts)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    want = {(f"1. word{i} end{i}", f"word{j}.{{0,3}}end{j}") for i in range(300) for j in range(300) if re.search(f"word{j}.{{0,3}}end{j}", f"1. word{i} end{i}")}
    assert {(r["header"], r["regex"]) for r in found.collect()} == want


@pytest.fixture
def observed(spark):
    rows = [("overview", "회사.{0,3}소개", f"회사의 소개 {i % 2}", "a", i) for i in range(3)] + [("overview", "매출", "매출", "b", i) for i in range(4)]
    rows += [("products", "(", "x", "c", i) for i in range(3)] + [("products", "상품", None, None, 9)]
    return spark.createDataFrame(rows, "target string, regex string, header string, source string, at int")


def test_proposal_store(spark, observed):
    none = spark.createDataFrame([], "target string, regex string, seen long, headers array<string>, sources array<string>, first_seen int, last_seen int")
    store = patterns.record_proposals(none, observed)
    assert {tuple(map(str, r)) for r in store.filter("target = 'overview'").collect()} == {
        ("overview", "회사.{0,3}소개", "3", "['회사의 소개 0', '회사의 소개 1']", "['a']", "0", "2"), ("overview", "매출", "4", "['매출']", "['b']", "0", "3")
    }
    fixtures = spark.createDataFrame([("revenue", "매출 및 수주"), ("overview", "사업의 개요")], "target string, header string")
    learned, left = patterns.apply_proposals(store, fixtures)
    assert [(r["target"], r["regex"], r["samples"], r["confirmed_count"], r["source"]) for r in learned.collect()] == [
        ("overview", "회사.{0,3}소개", ["회사의 소개 0", "회사의 소개 1"], 3, "learned")
    ]
    assert {(r["regex"], tuple(r["headers"])) for r in left.collect()} == {
        ("매출", ("매출", "__rejected_by:revenue")), ("(", ("x", "__invalid:no regular expression")), ("상품", ())
    }
    # A second round over what was left: tags stay, counts go on.
    again = patterns.record_proposals(left, observed.filter("regex = '상품'"))
    assert {(r["regex"], r["seen"]) for r in again.collect()} == {("매출", 4), ("(", 3), ("상품", 2)}
