"""URL filter: allow and block rules, and a logistic regression on hashed character n-grams for urls that no rule fits.

All of it is DataFrame functions. The labelled table, or the MAX_LABELLED rows of it with the least hashes, is gathered to one row of arrays,
and gradient descent is one aggregate expression over epochs on that row. The result is an array of BUCKETS weights,
whose size doesn't depend on any table; scoring looks n-grams up in it as a constant.

Features are the character n-grams (GRAMS) of ^host and path$, hashed by md5 to BUCKETS - 1 places; place 0 is the
bias. Each of a url's n features counts 1 / sqrt(n). A url is blocked if its score is 0 or more.

Defined results: for a null url, or one without ://, host and path are empty and the bias decides; labelled rows with
a null url or label are left out; without any, all weights are 0 and every url that no rule fits is blocked; repeated rows are judged
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 2048
GRAMS = (3, 4)
EPOCHS = 120
RATE = 2.0
DECAY = 0.002
MAX_LABELLED = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed rules: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: A small labelled table: hosts with their paths that are to be blocked, and others.
BLOCKED = (
    "spam-farm.example.org/en/1", "www.spam-farm.example.org/de/22/", "cheap-pills.example.net/en/3.html", "buy-cheap-pills.example.org/es/4",
    "casino-bonus.example.org/win/7", "free-casino.example.net/play", "best-viagra-online.example.org/", "win-free-prizes.example.net/claim/99",
    "hot-singles.example.org/chat", "adult-cams.example.net/live/12", "link-farm.example.org/en/812", "seo-links.example.net/buy/backlinks",
    "replica-watches.example.org/cheap/5", "payday-loans.example.net/apply", "crypto-doubler.example.org/deposit", "porn-tube.example.net/video/9",
    "download-crack.example.org/keygen/8", "spam-pills.example.net/fr/31", "cheap-casino.example.org/de/6", "farm-of-links.example.net/en/77.html",
)
ALLOWED = (
    "blog.thern.example.org/en/1", "www.thwhin.example.org/de/22/", "m.tionsh.example.net/en/3.html", "thering.example.org/es/4",
    "news.example.org/world/7", "docs.example.net/guide/start", "library.example.org/", "www.ththen.example.net/fr/99",
    "university.example.org/courses/12", "blog.theres.example.net/de/55", "recipes.example.org/en/812", "weather.example.net/today",
    "museum.example.org/visit/5", "m.ththat.example.net/en/616", "science.example.org/papers/8", "ththon.example.net/de/31",
    "forum.example.org/thread/9", "wiki.example.net/page/6", "blog.ththor.example.org/fr/77.html", "maps.example.org/city/3",
)


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url and blocked."""
    row = lambda u, y: F.struct(F.lit(f"https://{u}").alias("url"), F.lit(y).alias("blocked"))
    return spark.range(1).select(F.inline(F.array(*(row(u, 1) for u in BLOCKED), *(row(u, 0) for u in ALLOWED))))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def places(host: Column, path: Column) -> Column:
    """Places of all n-grams, and the bias's 0 in front."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))

    def grams(n: int) -> Column:
        place = lambda i: F.conv(F.substring(F.md5(F.substr(text, i, F.lit(n)).cast("binary")), 1, 6), 16, 10).cast("int") % (BUCKETS - 1) + 1
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), place)
        return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<int>"))

    return F.concat(F.array(F.lit(0)), *map(grams, GRAMS))


def _score(weights: Column, at: Column) -> Column:
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(weights, i)) / F.sqrt(F.size(at).cast("double"))


def train(table: DataFrame, url_col: str = "url", label_col: str = "blocked") -> list[float]:
    """BUCKETS weights, by gradient descent over the whole labelled table. Only these numbers come to the driver."""
    host, path = host_and_path(F.col(url_col))
    rows = table.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("host", "path", "y"), "host", "path", "y").limit(MAX_LABELLED).select("host", "path", "y", places(F.col("host"), F.col("path")).alias("at"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("host", "path", "y", "at"))).alias("rows"))
    # For each place, the examples that hold it (with repeats), so that a step is two passes over short arrays.
    numbered = one.select(F.posexplode("rows").alias("example", "row")).select("example", F.explode("row.at").alias("place"))
    by_place = numbered.groupBy("place").agg(F.sort_array(F.collect_list("example")).alias("examples")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "examples"))).alias("held")
    )
    empty = F.array().cast("array<int>")
    holders = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("held"), i), empty))
    both = one.join(by_place.select(holders.alias("holders")), F.lit(True))  # one row each

    def step(w: Column, _: Column) -> Column:
        error = F.transform("rows", lambda r: (r["y"] - 1 / (1 + F.exp(-_score(w, r["at"])))) / F.sqrt(F.size(r["at"]).cast("double")) / F.size("rows"))
        return F.aggregate(
            F.array(F.struct(error.alias("error"), w.alias("w"))),
            F.array().cast("array<double>"),
            lambda _, s: F.zip_with(s["w"], F.col("holders"), lambda x, held: x * (1 - DECAY) + RATE * F.aggregate(held, F.lit(0.0), lambda t, e: t + F.get(s["error"], e))),
        )

    start = F.array_repeat(F.lit(0.0), BUCKETS)
    weights = F.when(F.size("rows") == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, step))
    return list(both.select(weights.alias("w")).first()["w"])


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (a rule's host and its subdomains; paths that start with its path), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    constant = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    method = F.when(_score(constant, places(F.col("host"), F.col("path"))) >= 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def plain_weights() -> list[float]:
    """The built-in table's weights by the same rule in plain Python, for the SQL below and for tests."""
    import hashlib
    import math

    rows = []
    for url, y in sorted([(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED], key=lambda r: (r[0].split("/")[0], "/" + r[0].partition("/")[2])):
        text = f"^{url}$"
        at = [0] + [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:6], 16) % (BUCKETS - 1) + 1 for n in GRAMS for i in range(len(text) - n + 1)]
        rows.append((y, at))
    w = [0.0] * BUCKETS
    for _ in range(EPOCHS):
        change = [0.0] * BUCKETS
        for y, at in rows:
            error = (y - 1 / (1 + math.exp(-sum(w[i] for i in at) / math.sqrt(len(at))))) / math.sqrt(len(at)) / len(rows)
            for i in at:
                change[i] += error
        w = [x * (1 - DECAY) + RATE * c for x, c in zip(w, change, strict=True)]
    return w


def oracle_sql(table: str = "pages") -> str:
    """The same in DuckDB SQL, with the weights of plain_weights() as a constant."""
    grams = " || ".join(f"list_transform(range(1, length(t) - {n} + 2), lambda i: ('0x' || substr(md5(substr(t, i, {n})), 1, 6))::INT % {BUCKETS - 1} + 1)" for n in GRAMS)
    cases = {"rule": "", "verdict": ""}
    for text, says in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"
        cases["rule"] += f" WHEN {fits} THEN '{text}'"
        cases["verdict"] += f" WHEN {fits} THEN '{says}'"
    return f"""
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM {table}),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
marked AS (SELECT *, '^' || host || path || '$' AS t FROM parts),
placed AS (SELECT *, [0] || {grams} AS "at" FROM marked),
weights AS (SELECT [{", ".join(map(repr, plain_weights()))}]::DOUBLE[] AS w)
SELECT page_id, host, path, CASE{cases["rule"]} END AS rule,
       CASE{cases["verdict"]} ELSE CASE WHEN list_sum(list_transform("at", lambda i: w[i + 1])) >= 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM placed, weights"""
