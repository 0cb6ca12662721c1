"""Node ids and period keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLUG_MAX = 48


def squeezed(s: Column) -> Column:
    """Trimmed, with each run of white space (Unicode's included) as one space."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def slug(s: Column) -> Column:
    """Lower-cased, with all but digits, a-z and Hangul as single hyphens; long ones end in a hash of the original."""
    base = F.regexp_replace(F.regexp_replace(F.lower(squeezed(s)), "[^0-9a-z가-힣]+", "-"), "^-+|-+$", "")
    head = F.regexp_replace(F.substring(base, 1, SLUG_MAX - 7), "^-+|-+$", "")
    return F.when(F.length(base) <= SLUG_MAX, base).otherwise(F.concat(head, F.lit("-"), F.substring(F.sha1(s.cast("binary")), 1, 6)))


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def company_id(code: Column) -> Column:
    return node_id("company", code)


def stock_id(ticker: Column) -> Column:
    return node_id("stock", ticker)


def sector_id(code: Column) -> Column:
    return node_id("sector", code)


def region_id(code: Column) -> Column:
    return node_id("region", code)


def metric_id(key: Column) -> Column:
    return node_id("metric", key)


def period_id(year: Column, fiscal_period: Column) -> Column:
    return node_id("period", F.concat(year, fiscal_period))


def segment_id(name: Column, company_key: Column | None = None) -> Column:
    return node_id("segment", *([company_key] if company_key is not None else []), slug(name))


def customer_id(raw: Column) -> Column:
    return node_id("customer", slug(raw))


def person_id(name: Column, company_key: Column) -> Column:
    return node_id("person", company_key, slug(name))


def canonical_person_id(name: Column) -> Column:
    return node_id("person", slug(name))


def external_company_id(name: Column) -> Column:
    return F.concat(F.lit("company:ext:"), slug(name))


def fiscal_order(fiscal_period: Column) -> Column:
    order = F.when(fiscal_period == "Q1", 1).when(fiscal_period == "H1", 2).when(fiscal_period == "Q3", 3).when(fiscal_period == "FY", 4)
    return order.otherwise(0)


def period_key(year: Column, fiscal_period: Column) -> Column:
    """A sortable integer: year * 10 + the order of the fiscal period."""
    return year.cast("int") * 10 + fiscal_order(fiscal_period)


def label_key(label: Column) -> Column:
    """period_key of a label such as 2024H1 (or 2024, which sorts before all of its parts)."""
    return F.try_to_number(F.substring(label, 1, 4), F.lit("9999")).cast("int") * 10 + fiscal_order(F.substring(label, 5, 2))


def report_period(code: Column) -> Column:
    """Report codes to fiscal periods."""
    return F.when(code == "11011", "FY").when(code == "11012", "H1").when(code == "11013", "Q1").when(code == "11014", "Q3")
