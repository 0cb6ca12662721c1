"""Normalisers and parsers of raw cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.ids import squeezed

# The patterns that tell legal forms, institutions and relations apart.
CORP_AFFIX = r"(?iU)\(주\)|㈜|주식회사|\bco\.?,?\s*ltd\.?|\bltd\.?|\binc\.?|\bcorp\.?|\bcorporation\b|\bcompany\b"
HOLDER_AFFIX = r"(?iU)\(주\)|㈜|주식회사|유한회사|유한책임회사|합자회사|재단|\bco\.?,?\s*ltd\.?|\bltd\.?|\binc\.?|\bcorp\.?|\bcorporation\b|\bllc\b"
HOLDER_KEYWORD = "홀딩스|지주|투자|운용|자산운용|투신|증권|보험|은행|캐피탈|공단|연금|펀드|파트너스|벤처스|인베스트먼트|기금|조합"
RELATION_CORP = "계열회사|법인|기관"
RELATION_PERSON = "임원|배우자|자녀|친인척|형제자매|형제|친족"
SUMMARY_NAMES = ("계", "소계", "합계", "총계")
LARGEST = "본인|최대주주"
RATE_LIMIT = "rate limit|usage limit|5-hour limit|quota exceeded|too many requests"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalize_alias(s: Column) -> Column:
    return F.lower(squeezed(s))


def normalize_corp_name(s: Column) -> Column:
    return F.lower(squeezed(F.regexp_replace(F.regexp_replace(s, CORP_AFFIX, " "), "[,.]", " ")))


def classify_shareholder(name: Column, relation: Column) -> Column:
    """company or person: the name's legal form or kind first, then the relation's signs of a person, then of a company."""
    name, relation = F.coalesce(F.trim(name), F.lit("")), F.coalesce(F.trim(relation), F.lit(""))
    return (
        F.when(name.rlike(HOLDER_AFFIX) | name.rlike(HOLDER_KEYWORD), "company")
        .when(relation.rlike(RELATION_PERSON), "person")
        .when(relation.rlike(RELATION_CORP), "company")
        .otherwise("person")
    )


def is_largest(relation: Column) -> Column:
    return F.coalesce(relation.rlike(LARGEST), F.lit(False))


def is_summary(name: Column) -> Column:
    return F.coalesce(F.trim(name).isin(*SUMMARY_NAMES), F.lit(False))


def affiliation(stake_pct: Column) -> Column:
    return F.when(stake_pct >= 50, "자회사").when(stake_pct >= 20, "관계회사").otherwise("기타")


def _number(s: Column, kind: str) -> Column:
    return F.when(s.rlike(_NUMBER), s.try_cast(kind))


def parse_amount(raw: Column, kind: str = "decimal(22,2)") -> Column:
    """Commas go; empty, - and what is no number are null."""
    return _number(F.trim(F.regexp_replace(raw.cast("string"), ",", "")), kind)


def parse_percent(raw: Column) -> Column:
    return _number(F.trim(F.regexp_replace(raw.cast("string"), "[,%]", "")), "double")


def parse_count(raw: Column) -> Column:
    """Whole part of a number."""
    return parse_percent(raw).try_cast("long")


def coerce_share(raw: Column) -> Column:
    """The first number in a string; null if there is none."""
    return F.regexp_extract(raw.cast("string"), r"\d+(\.\d+)?", 0).try_cast("double")


def json_block(text: Column) -> Column:
    """The text if it is JSON as a whole, else the first fenced block that is, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    valid = lambda s: F.when(F.try_parse_json(s).isNotNull(), s)
    whole = F.when(F.trim(text) != "", valid(F.trim(text)))
    return F.coalesce(whole, F.when(fenced != "", valid(fenced)))


def ratio_percent(top: Column, bottom: Column) -> Column:
    """100 * top / bottom, null if either is missing or bottom is 0."""
    return F.when(bottom != 0, top.cast("double") * 100 / bottom.cast("double"))


def cost_estimate(chars: Column) -> Column:
    """Dollars for a target: a fixed part and one by length, to four places."""
    return F.round(F.lit("0.05").cast("decimal(8,4)") + chars.cast("decimal(12,0)") * F.lit("0.000009").cast("decimal(8,6)"), 4).cast("decimal(8,4)")


def year_of_report(name: Column) -> Column:
    year = F.regexp_extract(name, r"\((\d{4})\.", 1)
    return F.when(year != "", year)


def compact_date(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date")


def years(spec: Column) -> Column:
    """Periods from 'a:b' or 'a-b' (inclusive), 'a,b,c', or one year."""
    bounds = F.split(spec, "[:-]")
    some = F.transform(F.split(spec, ","), lambda y: F.trim(y))
    ranged = F.transform(F.sequence(F.get(bounds, 0).try_cast("int"), F.get(bounds, 1).try_cast("int")), lambda y: y.cast("string"))
    return F.when(spec.rlike(r"^\d{4}[:-]\d{4}$"), ranged).otherwise(some)


def recent_years(year: Column, n: int) -> Column:
    return F.sequence(year - F.lit(n - 1), year)


def failure_kind(exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """How an external call failed: rate_limit, transient (nothing was said) or error."""
    said = F.lower(F.concat(F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))))
    return F.when(exit_code == 0, "ok").when(said.rlike(RATE_LIMIT), "rate_limit").when(F.trim(said) == "", "transient").otherwise("error")
