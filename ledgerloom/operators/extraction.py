"""From an answer's text to an extraction record: strict JSON, with one verdict a record and the path of each fault.

A record is an object of exactly period, segments, customers and geographic; its items may hold no other keys than those
of ITEMS. Shares may be written as text that holds a number; they lie between 0 and 100. Regions without a share are left out
before the record is judged. All is column expressions over one parsed variant. Answers are few bytes and much work:
deal them evenly over tasks first (`common.dealt`), as `extract` does; a file that fits one task would leave all of it to that one.

A fault is a path ($.segments[2].share_pct) and one of: json (no JSON, or a fence without JSON), missing, extra, type,
number (text without a number), range, choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators.common import dealt, written
from ledgerloom.schema import EXTRACTION

FAULTS = "array<struct<path: string, fault: string>>"


@dataclass(frozen=True)
class Item:
    """A key of an item: its kind (text, share, texts or choice), and whether it may be left out or null."""

    kind: str
    needed: bool = False
    choices: tuple[str, ...] = ()
    default: str | None = None
    nullable: bool = True


# The keys of a record and of its items, and the choices among which their values lie.
ITEMS = {
    "segments": {"name_ko": Item("text", True), "share_pct": Item("share"), "description": Item("text"), "products": Item("texts", nullable=False)},
    "customers": {
        "name_raw": Item("text", True), "revenue_share_pct": Item("share"),
        "tier": Item("choice", choices=("1차", "2차", "unknown"), default="unknown", nullable=False)
    },
    "geographic": {"region_code": Item("choice", True, ("KR", "US", "EU", "CN", "JP", "ROW")), "share_pct": Item("share", True)},
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once however often body names it: inside lambdas nothing else shares common parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT; null for a key that isn't there."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _fault(path: Column, fault: str | Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(fault) if isinstance(fault, str) else fault).alias("fault"))


def _listed(fault: Column, path: Column) -> Column:
    """A list of one fault, or of none where fault is null."""
    return F.transform(F.filter(F.array(fault), lambda f: f.isNotNull()), lambda f: _fault(path, f))


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string, variant>")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _share(value: Column) -> Column:
    """A number, a truth value as 1 or 0, or the first number in a text."""
    flag = F.try_variant_get(value, "$", "boolean").cast("int").cast("double")
    number = F.try_variant_get(value, "$", "double")
    return _let(_kind(value), lambda kind: F.when(kind == "STRING", normalize.coerce_share(_text(value))).when(kind == "BOOLEAN", flag).otherwise(number))


def _value_fault(item: Item, value: Column, kind: Column) -> Column:
    if item.kind == "text":
        return F.when(kind != "STRING", "type")
    if item.kind == "choice":
        return F.when(kind != "STRING", "type").when(~_text(value).isin(*item.choices), "choice")
    if item.kind == "texts":
        return F.when(kind != "ARRAY", "type").when(F.exists(_items(value), lambda x: F.coalesce(_kind(x), F.lit("VOID")) != "STRING"), "type")
    known = kind.isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")
    out_of = lambda share: F.when(share.isNull(), "number").when((share < 0) | (share > 100), "range")
    return F.when(~known, "type").otherwise(_let(_share(value), out_of))


def _key_fault(item: Item, keys: Column, key: str, value: Column) -> Column:
    absent = ~F.array_contains(keys, key)
    when_null = F.lit("type") if item.needed or not item.nullable else F.lit(None).cast("string")
    held = lambda kind: F.when(kind == "VOID", when_null).otherwise(_value_fault(item, value, kind))
    return F.when(absent, F.lit("missing" if item.needed else None).cast("string")).otherwise(_let(F.coalesce(_kind(value), F.lit("VOID")), held))


def _object_faults(value: Column, path: Column, known: dict[str, Callable[[Column, Column, Column], Column]]) -> Column:
    """Faults of an object whose keys are known: others, and what each check (value, path, keys) finds."""
    extra = lambda keys: F.transform(
        F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)))), lambda k: _fault(F.concat(path, F.lit("."), k), "extra")
    )

    def found(held: Column) -> Column:
        checks = [_let(held[key], _check(check, F.concat(path, F.lit(f".{key}")), held)) for key, check in known.items()]
        return F.when(held.isNull(), F.array(_fault(path, "type"))).otherwise(F.flatten(F.array(extra(F.map_keys(held)), *checks)))

    return _let(_object(value), found)


def _check(check: Callable[[Column, Column, Column], Column], path: Column, held: Column) -> Callable[[Column], Column]:
    return lambda value: check(value, path, F.map_keys(held))


def _items_check(field: str) -> Callable[[Column, Column, Column], Column]:
    spec = ITEMS[field]
    of_key = lambda key: lambda value, path, keys: _listed(_key_fault(spec[key], keys, key, value), path)

    def check(value: Column, path: Column, keys: Column) -> Column:
        items = F.transform(_taken(field, value), lambda x, i: _object_faults(x, F.concat(path, F.lit("["), i, F.lit("]")), {key: of_key(key) for key in spec}))
        return (
            F.when(~F.array_contains(keys, field), F.array(_fault(path, "missing")))
            .when(F.coalesce(_kind(value), F.lit("VOID")) != "ARRAY", F.array(_fault(path, "type"))).otherwise(F.flatten(items))
        )

    return check


def _taken(field: str, value: Column) -> Column:
    """A field's items; of regions those that have a share."""
    if field != "geographic":
        return _items(value)
    has = lambda x: F.coalesce(_kind(_object(x)["share_pct"]), F.lit("VOID")) != "VOID"
    return F.filter(_items(value), has)


def faults(parsed: Column) -> Column:
    """All faults of a parsed variant (null: no JSON), in the order of the record's fields."""
    period = lambda value, path, keys: _listed(_key_fault(Item("text", True), keys, "period", value), path)
    found = _object_faults(parsed, F.lit("$"), {"period": period} | {field: _items_check(field) for field in ITEMS})
    return F.when(parsed.isNull(), F.array(_fault(F.lit("$"), "json"))).otherwise(found)


def record(parsed: Column) -> Column:
    """The record of a variant without faults, in the type that the ingest takes."""

    def of(item: Item, value: Column) -> Column:
        if item.kind == "share":
            return _share(value)
        if item.kind == "texts":
            return F.coalesce(F.transform(_items(value), _text), F.array().cast("array<string>"))
        return F.coalesce(_text(value), F.lit(item.default)) if item.default else _text(value)

    def of_item(spec: dict[str, Item]) -> Callable[[Column], Column]:
        return lambda held: F.struct(*(of(item, held[key]).alias(key) for key, item in spec.items()))

    top = _object(parsed)
    made = [_text(top["period"]).alias("period")]
    for field, spec in ITEMS.items():
        made.append(F.transform(F.transform(_taken(field, top[field]), _object), of_item(spec)).alias(field))
    return F.struct(*made).cast(EXTRACTION)


def _parsed(text: Column) -> Column:
    """The text as JSON if it is that as a whole, else its first fenced block."""
    whole = F.try_parse_json(F.nullif(F.trim(text), F.lit("")))
    return F.coalesce(whole, F.try_parse_json(normalize.json_block(text)))


def parse_answers(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """answers with faults and record (null if there is any fault). One verdict a row, and no row is lost."""
    parsed = answers.withColumn("_parsed", _parsed(F.col(text_col)))
    # Out of a list of one: filters on a verdict stay above it, else Spark judges a record once more for each, and before rows are dealt.
    judged = parsed.select("*", F.explode_outer(F.array(faults(F.col("_parsed")))).alias("faults"))
    return judged.withColumn("record", F.when(F.size("faults") == 0, record(F.col("_parsed")))).drop("_parsed")


def rejects(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, fault: a row for each fault."""
    return parsed.select(*keys, F.inline("faults"))


def extract(reports: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(extractions, rejects) of reports (company_code, rcept_no, text, period) by any extractor that adds a column answer.

    extractions: company_code, rcept_no, record, as the structure run takes them.
    """
    parsed = written(parse_answers(dealt(extractor(reports))), "answers")  # the extractor is asked once
    return parsed.filter("record is not null").select("company_code", "rcept_no", "record"), rejects(parsed, ["company_code", "rcept_no"])

