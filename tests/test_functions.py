import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import ids, normalize, text


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def plain_slug(s):
    base = re.sub(r"\s+", " ", s.strip()).lower()
    base = re.sub("[^0-9a-z가-힣]+", "-", base).strip("-")
    return base if len(base) <= 48 else base[:41].strip("-") + "-" + hashlib.sha1(s.encode()).hexdigest()[:6]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", categories=["L", "Nd", "Zs", "P"], max_codepoint=0xD7A3), max_size=80), min_size=1, max_size=30))
def test_slug(spark, values):
    values = [v for v in values if v.lower() == "".join(c.lower() for c in v)]
    rows = spark.createDataFrame([(v,) for v in values], "s string").select("s", ids.slug(F.col("s")).alias("x")).collect()
    for r in rows:
        assert r["x"] == plain_slug(r["s"])


@pytest.mark.parametrize("raw, want", [("-5,000", -5000), ("", None), ("-", None), ("1,000", 1000), ("12d", None), ("nan", None), ("1.5", 1.5), (None, None)])
def test_amounts(spark, raw, want):
    got = one(spark, normalize.parse_amount(F.col("a")), a=raw)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("raw, want", [("52.3%", 52.3), ("약 30", 30.0), ("1,234", 1.0), ("none", None)])
def test_shares(spark, raw, want):
    assert one(spark, normalize.coerce_share(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    "name, relation, want",
    [("삼성생명보험", "", "company"), ("홍길동", "계열회사 임원", "person"), ("홍길동", "계열회사", "company"), ("홍길동", None, "person"), (None, None, "person"), ("Foo Co., Ltd.", "", "company")],
)
def test_holders(spark, name, relation, want):
    assert one(spark, normalize.classify_shareholder(F.col("a"), F.col("b")), a=name, b=relation) == want


def test_corp_names(spark):
    for raw in ("(주) 현대 ", "㈜현대", "현대 주식회사", "현대, Inc.", "현대 Co., Ltd."):
        assert one(spark, normalize.normalize_corp_name(F.col("a")), a=raw) == "현대"


def test_years_and_dates(spark):
    assert one(spark, normalize.years(F.col("a")), a="2021:2023") == ["2021", "2022", "2023"]
    assert one(spark, normalize.years(F.col("a")), a="2021, 2023") == ["2021", "2023"]
    assert one(spark, normalize.years(F.col("a")), a="2021-2022") == ["2021", "2022"]
    assert str(one(spark, normalize.compact_date(F.col("a")), a="20240331")) == "2024-03-31"
    assert one(spark, normalize.compact_date(F.col("a")), a="x") is None
    assert one(spark, normalize.year_of_report(F.col("a")), a="사업보고서 (2023.12)") == "2023"
    assert one(spark, ids.label_key(F.col("a")), a="2024H1") == 20242


def test_json_and_failures(spark):
    assert one(spark, normalize.json_block(F.col("a")), a='x\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, normalize.json_block(F.col("a")), a="nothing") is None
    kind = normalize.failure_kind(F.col("c").cast("int"), F.col("o"), F.col("e"))
    assert one(spark, kind, c="1", o="", e="") == "transient"
    assert one(spark, kind, c="1", o="", e="Usage limit reached") == "rate_limit"
    assert one(spark, kind, c="1", o="", e="boom") == "error"


def test_cost(spark):
    assert float(one(spark, normalize.cost_estimate(F.col("a")), a="5491")) == 0.0994


def test_headers_and_html(spark):
    assert one(spark, text.header_text(F.col("a")), a=" 2. 주요 제품 및 서비스 ") == "주요 제품 및 서비스"
    assert one(spark, text.header_text(F.col("a")), a="2 주요") is None
    assert one(spark, text.header_target(F.col("a")), a="제품 및 서비스와 매출") == "products"
    html = "<html><style>x</style><h1>1. A</h1><table><tr><td>a</td><td>b</td></tr></table><script>y</script></html>"
    assert one(spark, text.html_lines(F.col("a")), a=html)[0] == "1. A"
    assert one(spark, text.keyword_pattern(F.col("a")), a="(제조서비스업) 주요 제품 등") == "주요.{0,3}제품"
    assert one(spark, text.keyword_pattern(F.col("a")), a="등 및") is None


def test_general_is_written_as_c_writes_it(spark):
    rng = random.Random(3)
    some = [0.0, 1250.125, 1250.375, 12345.25, 100000.5, 100001.5, 1.234565, 1.234575, 0.285, 9.9999995, 99999.95, 999999.4, 0.0001, 0.00012345, 1e-5, 1e6, 1234567.0, -12.345678, 0.1 + 0.2, 100.0]
    some += [i / 8 for i in range(7990, 12_000)] + [rng.randrange(10**7) * 10 + 5 for _ in range(500)] + [(rng.randrange(10**6) * 10 + 5) / 10 ** rng.randrange(2, 11) for _ in range(3000)]
    some += [rng.random() * 10 ** rng.randrange(-4, 7) for _ in range(3000)]
    some = [float(x) for x in some if not 999_999.5 <= x < 1e9 or x in (1e6, 1234567.0)]
    df = spark.createDataFrame([(x,) for x in some], "x double").select("x", text.general(F.col("x")).alias("got"))
    wrong = [(r["x"], r["got"], f"{r['x']:g}") for r in df.collect() if r["got"] != f"{r['x']:g}" and not (0 < r["x"] < 1e-4)]
    assert not wrong, wrong[:5]
