"""Many learned patterns against many headers: a literal index picks the pairs that can match, and only these are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text
from ledgerloom.operators.common import first_of

TARGETS = tuple(text.TARGET_PATTERNS)
SALTS = 8
_CUT = "\u0000"


def checked(patterns: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """patterns (target, regex, ...) with usable (the regex if it compiles, else null) and problem (null if there is none).

    Problems: an unknown or missing target, no regular expression, a pattern that matches the empty text.
    """
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("regex"))
    unknown = F.concat(F.lit("unknown target "), F.coalesce("target", F.lit("null")))
    problem = F.when(~F.coalesce(F.col("target").isin(*targets), F.lit(False)), unknown).when(F.col("usable").isNull(), "no regular expression").when(
        F.rlike(F.lit(""), F.col("usable")), "matches everything"
    )
    return patterns.withColumn("usable", compiled).withColumn("problem", problem)


def required_pieces(regex: Column) -> Column:
    """Texts that each match of a regex holds; none where that can't be told by its form (groups, alternatives, classes).

    What may be missing (an atom before ?, * or a count) and what stands for any text cuts the pattern into pieces.
    """
    optional = r"(?s)(?:\\[^A-Za-z0-9\\]|[^\\])(?:[*?]|\{\d+(?:,\d*)?\})[?+]?"
    rest = F.regexp_replace(F.regexp_replace(regex, optional, _CUT), r"(?<!\\)(?:\+[?+]?|[.^$])", _CUT)
    unclear = regex.rlike(r"\\[A-Za-z0-9\\]|\\$") | rest.rlike(r"(?<!\\)[|()\[\]{}*?]") | regex.rlike(r"(?<!\\)[|()\[\]]")
    pieces = F.transform(F.split(rest, _CUT), lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1"))
    return F.when(unclear, F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda x: x != ""))


def grams(s: Column, width: int) -> Column:
    """All substrings of so many characters, each once."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{width}}}))"), 1))


def _keys(regex: Column) -> Column:
    """Index keys of a pattern: its pieces' grams of three characters, else of two, else the empty key, which every header has."""
    of = lambda width: F.array_distinct(F.flatten(F.transform(required_pieces(regex), lambda x: grams(x, width))))
    return F.when(F.size(of(3)) > 0, of(3)).when(F.size(of(2)) > 0, of(2)).otherwise(F.array(F.lit("")))


def matches(patterns: DataFrame, headers: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """header, target, regex: which usable patterns (target, regex) occur in which texts (header). Each pair once, repeated rows or not.

    A pattern is looked up under the rarest of its keys, so that it is tried on headers that hold that key alone;
    patterns without a literal are tried on all. Headers under one key are dealt over salts. Null headers match nothing.
    """
    usable = checked(patterns.select("target", "regex").distinct(), targets).filter("problem is null")
    keyed = usable.select("target", "regex", F.explode(_keys(F.col("regex"))).alias("key"))
    texts = headers.filter("header is not null").select("header").distinct()
    all_keys = F.concat(F.array(F.lit("")), grams(F.col("header"), 3), grams(F.col("header"), 2))
    posted = texts.select("header", F.explode(all_keys).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
    found = posted.groupBy("key").agg(F.count("*").alias("n"))
    rarest = first_of(keyed.join(found, "key", "left"), ["target", "regex"], [F.coalesce("n", F.lit(0)), F.col("key")])
    dealt = rarest.select("target", "regex", "key", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = posted.withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["key", "salt"]).filter(F.rlike(F.col("header"), F.col("regex"))).select("header", "target", "regex")


def rejects(patterns: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """target, regex, problem of the patterns that can't be used, each once."""
    return checked(patterns.select("target", "regex").distinct(), targets).filter("problem is not null").select("target", "regex", "problem")


# ---- the store of proposals

def record_proposals(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """The store (target, regex, seen, headers, sources, first_seen, last_seen) after observations (target, regex, header, source, at).

    Counts add up; headers and sources are united and sorted; null ones are not kept. One shuffle, with partial sums.
    """
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>")).alias(f"{c}s")
    new = observed.select("target", "regex", F.lit(1).cast("long").alias("seen"), one("header"), one("source"), F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return stored.select(*new.columns).unionByName(new).groupBy("target", "regex").agg(
        F.sum("seen").alias("seen"), united("headers"), united("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def judged_proposals(store: DataFrame, fixtures: DataFrame, least: int = 3) -> DataFrame:
    """The store with promoted and tag. A proposal is promoted if seen often enough and if its pattern is usable and hits no header of another target.

    fixtures: target, header. The tag says why a proposal that was seen often enough stays: __rejected_by:<the least
    target that it hits> or __invalid:<problem>.
    """
    ready = store.filter(F.col("seen") >= least)
    others = fixtures.select(F.col("target").alias("other"), "header").distinct()
    hits = matches(ready, others).join(others, "header").filter(F.col("other") != F.col("target")).groupBy("target", "regex").agg(F.min("other").alias("hit"))
    out = checked(store).join(hits, ["target", "regex"], "left")
    tag = F.when(F.col("seen") < least, None).when(F.col("problem").isNotNull(), F.concat(F.lit("__invalid:"), "problem")).when(
        F.col("hit").isNotNull(), F.concat(F.lit("__rejected_by:"), "hit")
    )
    return out.withColumn("tag", tag).withColumn("promoted", (F.col("seen") >= least) & F.col("tag").isNull()).select(*store.columns, "promoted", "tag")


def apply_proposals(store: DataFrame, fixtures: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(patterns learned: target, regex, samples, confirmed_count, source, ordinal; the store without them, tags behind their headers)."""
    judged = judged_proposals(store, fixtures, least)
    samples = F.filter("headers", lambda h: ~h.startswith("__"))
    learned = judged.filter("promoted").select(
        "target", "regex", samples.alias("samples"), F.col("seen").alias("confirmed_count"), F.lit("learned").alias("source"), F.col("first_seen").alias("ordinal")
    )
    tagged = F.when(F.col("tag").isNull(), F.col("headers")).otherwise(F.array_union("headers", F.array("tag")))
    return learned, judged.filter("not promoted").withColumn("headers", tagged).select(*store.columns)
