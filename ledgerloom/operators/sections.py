"""Sections of filings: numbered headers, their bodies, and escalation by what the patterns could settle; pattern learning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import text
from ledgerloom.operators import patterns
from ledgerloom.operators.common import first_of

TARGETS = tuple(text.TARGET_PATTERNS)


def numbered_lines(docs: DataFrame, doc_col: str, lines: Column) -> DataFrame:
    return docs.select(F.col(doc_col).alias("doc"), F.posexplode(lines).alias("line_no", "line"))


def headers(lines: DataFrame) -> DataFrame:
    """doc, line_no, title, next_line (where the body ends; null at the document's end). With two numeric headers or more, only those count."""
    found = lines.withColumn("title", text.header_text(F.col("line"))).filter("title is not null").withColumn("numeric", F.col("line").rlike(text.NUMERIC_HEADER))
    numeric = F.sum(F.col("numeric").cast("int")).over(Window.partitionBy("doc"))
    kept = found.withColumn("n_numeric", numeric).filter("n_numeric < 2 or numeric")
    return kept.select("doc", "line_no", "title", F.lead("line_no").over(Window.partitionBy("doc").orderBy("line_no")).alias("next_line"))


def bodies(lines: DataFrame, found: DataFrame) -> DataFrame:
    """doc, line_no, title, body, chars. Each line finds its header by a running maximum, not by a range join."""
    marked = lines.join(found.select("doc", "line_no", "title"), ["doc", "line_no"], "left")
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("head", F.max(F.when(F.col("title").isNotNull(), F.col("line_no"))).over(upto)).filter("head is not null")
    parts = F.sort_array(F.collect_list(F.when(F.col("line_no") != F.col("head"), F.struct("line_no", "line"))))
    out = owned.groupBy("doc", "head").agg(F.max("title").alias("title"), parts.alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    return out.select("doc", F.col("head").alias("line_no"), "title", body.alias("body"), F.length(body).alias("chars"))


def sections(
    docs: DataFrame, doc_col: str, lines: Column, patterns: dict[str, tuple[str, ...]] | None = None, fallback: DataFrame | None = None,
    least: int = text.MIN_SECTION
) -> DataFrame:
    """A row a document: level (regex, regex+llm, full_text), skipped, invalid, output.

    The first header of each target counts. fallback (doc, target, choice) answers, for documents with missing or short
    targets, which of the unused headers (from 1) a target is; answers out of range are ignored. If a target is still
    short, or nothing matched, the whole text is the output.
    """
    rows = numbered_lines(docs, doc_col, lines)
    found = headers(rows)
    held = bodies(rows, found).withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("line_no")))
    targets = {t: (patterns or text.TARGET_PATTERNS)[t] for t in (patterns or text.TARGET_PATTERNS)}
    matched = first_of(
        held.withColumn("target", text.header_target(F.col("title"), targets)).filter("target is not null"), ["doc", "target"], [F.col("line_no")]
    ).withColumn("by", F.lit("regex"))
    if fallback is not None:
        used = matched.filter(F.col("chars") >= least).select("doc", "line_no")
        open_ = held.join(used, ["doc", "line_no"], "left_anti").withColumn("choice", F.row_number().over(Window.partitionBy("doc").orderBy("line_no")))
        settled = matched.filter(F.col("chars") >= least).select("doc", "target")
        answers = open_.join(fallback.join(settled, ["doc", "target"], "left_anti"), ["doc", "choice"]).drop("choice").withColumn("by", F.lit("llm"))
        matched = first_of(matched.unionByName(answers.select(*matched.columns)), ["doc", "target"], [F.col("by")])
    order = F.array(*map(F.lit, targets))
    part = F.struct(F.array_position(order, F.col("target")).alias("at"), F.concat(F.lit("## "), "title", F.lit("\n"), "body").alias("part"))
    summed = matched.groupBy("doc").agg(
        F.array_sort(F.collect_list("target")).alias("got"),
        F.array_sort(F.collect_list(F.when(F.col("chars") < least, F.col("target")))).alias("invalid"),
        F.sort_array(F.collect_list(F.when(F.col("chars") >= least, part))).alias("parts"),
        F.max((F.col("by") == "llm").cast("int")).alias("asked"),
    )
    whole = docs.select(F.col(doc_col).alias("doc"), F.array_join(lines, "\n").alias("whole"))
    none = F.array().cast("array<string>")
    out = whole.join(summed, "doc", "left")
    full = F.col("got").isNull() | (F.size("invalid") > 0)
    output = F.when(full, F.col("whole")).otherwise(F.array_join(F.transform("parts", lambda p: p["part"]), "\n"))
    level = F.when(full, "full_text").when(F.col("asked") == 1, "regex+llm").otherwise("regex")
    return out.select(
        "doc", level.alias("level"), F.array_except(F.array_sort(order), F.coalesce("got", none)).alias("skipped"),
        F.coalesce("invalid", none).alias("invalid"), output.alias("output"), F.length(output).alias("output_chars")
    )


def consolidate_patterns(entries: DataFrame) -> DataFrame:
    """One row for each target and regex: samples united and sorted, counts summed, source of the first entry (by ordinal)."""
    return entries.groupBy("target", "regex").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))).alias("samples"),
        F.sum("confirmed_count").alias("confirmed_count"),
        F.min_by("source", "ordinal").alias("source"),
    )


def promote_proposals(observed: DataFrame, least: int = 3) -> DataFrame:
    """target, regex, seen, headers, first_seen, last_seen, promoted: proposals are promoted when seen often enough and not refuted."""
    summed = observed.groupBy("target", "regex").agg(
        F.count("*").alias("seen"), F.array_sort(F.collect_set("header")).alias("headers"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.coalesce(F.bool_or("refuted"), F.lit(False)).alias("refuted"),
    )
    return summed.withColumn("promoted", (F.col("seen") >= least) & ~F.col("refuted"))


def known_patterns(baseline: DataFrame, stored: DataFrame) -> DataFrame:
    """All patterns in use: the built-in ones, and of the stored ones those that were learned. Columns of baseline."""
    return consolidate_patterns(baseline.unionByName(stored.filter("source = 'learned'").select(*baseline.columns)))


def pattern_problem(target: str, regex: str) -> str | None:
    """Why a pattern can't be added, or None: its target is unknown, or it isn't a regular expression that says something."""
    if target not in TARGETS:
        return f"unknown target {target}"
    try:
        found = re.compile(regex)
    except re.error as e:
        return f"no regular expression: {e}"
    return "matches everything" if found.search("") else None


def pattern_stats(patterns: DataFrame) -> DataFrame:
    """target, source, n."""
    return patterns.groupBy("target", "source").agg(F.count("*").alias("n"))


def validate_proposals(proposals: DataFrame, fixtures: DataFrame, least: int = 3) -> DataFrame:
    """Proposals (as from promote_proposals) with promoted and tag, checked against fixtures (target, header): headers that a target has.

    A proposal whose pattern hits a header of another target is rejected and tagged with that target, one that can't be
    used with its problem. Patterns meet headers through the index of `patterns.matches`.
    """
    others = fixtures.select(F.col("target").alias("other"), "header").distinct()
    met = patterns.matches(proposals, others).join(others, "header").filter(F.col("other") != F.col("target"))
    judged = patterns.checked(proposals).join(met.groupBy("target", "regex").agg(F.min("other").alias("hit")), ["target", "regex"], "left")
    tag = F.when(F.col("problem").isNotNull(), F.concat(F.lit("__invalid:"), "problem")).when(F.col("hit").isNotNull(), F.concat(F.lit("__rejected_by:"), "hit"))
    held = [c for c in proposals.columns if c not in ("promoted", "tag")]
    promoted = (F.col("seen") >= least) & ~F.col("refuted") & F.col("tag").isNull()
    return judged.withColumn("tag", tag).withColumn("promoted", promoted).select(*held, "promoted", "tag")
