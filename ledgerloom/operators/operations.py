"""Operations: the work queue, budgets, incremental candidates, listing lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators.common import written

MAX_ATTEMPTS = 3
STALE_MINUTES = 180


def queue_next(queue: DataFrame, budget: int, max_targets: int | None = None) -> DataFrame:
    """The next pending targets in order of id, within the budget. A limit rather than a global window: only the head is kept."""
    n = budget if max_targets is None else min(budget, max_targets)
    return queue.filter("status = 'pending'").orderBy("id").limit(n)


def transition(attempts: Column, outcome: Column, message: Column) -> tuple[Column, Column]:
    """(status, attempts) after a run. outcome: ok, fetch_error or extract_error; fetch errors are tried again, a missing report is skipped."""
    tries = attempts + 1
    missing = (outcome == "fetch_error") & F.coalesce(message.contains("no report"), F.lit(False))
    status = (
        F.when(outcome == "ok", "done").when(missing, "skipped")
        .when((outcome == "fetch_error") & (tries < MAX_ATTEMPTS), "pending").otherwise("failed")
    )
    return status, tries


def reset_stale(queue: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    stale = (F.col("status") == "in_progress") & (F.col("last_attempt_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def within_budget(calls: DataFrame, at: str, order: list[Column], cost: str, cap: int, offset_hours: int = 9) -> DataFrame:
    """Calls that fit a daily cap; days change at local midnight (offset_hours from UTC). order should be total, costs not negative.

    A prefix sum in parts: calls are dealt to ranges of day and order and each range is summed; the sums before a range are its
    offset, and ranges that begin over the cap are left out before any call is looked at again. So no task holds a day.
    """
    day = F.to_date(F.col(at) + F.expr(f"INTERVAL {offset_hours} HOURS"))
    dealt = calls.withColumn("day", day).repartitionByRange("day", *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "budget")  # what a part holds must not change between its sum and its calls
    sums = dealt.groupBy("day", "_part").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("day").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")
    open_parts = sums.select(F.col("day").alias("_day"), F.col("_part").alias("_of"), before.alias("_before")).filter(F.col("_before") <= cap)  # a row a part
    kept = dealt.join(open_parts, F.col("day").eqNullSafe(F.col("_day")) & (F.col("_part") == F.col("_of"))).drop("_day", "_of")
    running = Window.partitionBy("day", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("used", F.col("_before") + F.sum(cost).over(running)).filter(F.col("used") <= cap).drop("_part", "_before")


def new_reports(listed: DataFrame, universe: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """Listed reports of a kind, of companies in the universe, not known yet; each once."""
    wanted = listed.filter(F.col("report_nm").startswith(prefix)).join(universe, "corp_code", "left_semi")
    return wanted.join(known, "rcept_no", "left_anti").dropDuplicates(["rcept_no"]).withColumn("period", normalize.year_of_report(F.col("report_nm")))


def lifecycle(existing: DataFrame, listed: DataFrame, registered: DataFrame) -> DataFrame:
    """ticker, change (added, relisted, updated, delisted, unlinked) of stocks against today's listing, in one full join."""
    reg = registered.select("ticker").distinct().withColumn("known", F.lit(True))
    both = existing.select(
        "ticker", F.lit(True).alias("had"), F.col("delisted_at").isNotNull().alias("gone")
    ).join(listed.select("ticker", "market"), "ticker", "full_outer").join(reg, "ticker", "left")
    change = (
        F.when(F.col("market").isNull() & ~F.col("gone"), "delisted").when(F.col("market").isNotNull() & F.col("known").isNull(), "unlinked")
        .when(F.col("market").isNotNull() & F.col("had").isNull(), "added").when(F.col("market").isNotNull() & F.col("gone"), "relisted")
        .when(F.col("market").isNotNull(), "updated")
    )
    return both.select("ticker", change.alias("change")).filter("change is not null")


def listing(kospi: DataFrame, kosdaq: DataFrame) -> DataFrame:
    """ticker, market of two listings; the second wins."""
    both = kospi.select("ticker", F.lit("KOSPI").alias("market"), F.lit(1).alias("p")).unionByName(kosdaq.select("ticker", F.lit("KOSDAQ").alias("market"), F.lit(2).alias("p")))
    return both.groupBy("ticker").agg(F.max_by("market", "p").alias("market"))


def enrol(companies: DataFrame, periods: list[str], queue: DataFrame) -> DataFrame:
    """corp_code, period of targets that the queue doesn't hold: companies times a given list of periods, as an explode."""
    wanted = companies.select("corp_code", F.explode(F.array(*map(F.lit, periods))).alias("period"))
    return wanted.join(queue.select("corp_code", "period"), ["corp_code", "period"], "left_anti")


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("cost_estimate_usd"), F.lit(0)).alias("cost"))


def top_cost(queue: DataFrame, n: int = 10) -> DataFrame:
    return queue.filter("cost_estimate_usd is not null").orderBy(F.desc("cost_estimate_usd"), "id").limit(n)


def latest_report(listed: DataFrame, prefix: str) -> DataFrame:
    """corp_code, period, rcept_no: the last filed report of a kind for each company and period.

    Only filings from January to the first of July of the year after the period count; later ones are of another year's business.
    """
    named = listed.filter(F.col("report_nm").startswith(prefix)).withColumn("period", normalize.year_of_report(F.col("report_nm")))
    after = (F.col("period").cast("int") + 1).cast("string")
    inside = F.col("rcept_dt").between(F.concat(after, F.lit("0101")), F.concat(after, F.lit("0701")))
    wanted = named.filter(F.col("period").isNotNull() & inside)
    return wanted.groupBy("corp_code", "period").agg(F.max_by("rcept_no", F.struct("rcept_dt", "rcept_no")).alias("rcept_no"))


def years_with_floor(years: DataFrame, key: str, year: int, n: int) -> DataFrame:
    """The years on record and the n most recent ones, a sorted array for each key."""
    recent = F.array(*(F.lit(y) for y in range(year - n + 1, year + 1)))
    return years.groupBy(key).agg(F.array_sort(F.array_union(F.collect_set("year"), recent)).alias("years"))


def report_targets(companies: DataFrame, reported: DataFrame, codes: tuple[str, ...], year: int, n: int = 3, years: list[str] | None = None) -> DataFrame:
    """corp_code, bsns_year, reprt_code of the reports to ask for.

    For each company the years that it has reported (company_id, year) and the n most recent ones, or the given years alone; each with
    all report codes. companies: company_id, corp_code. Both lists are short and given, so they are an explode.
    """
    if years is not None:
        wanted = companies.select("corp_code", F.explode(F.array(*map(F.lit, years))).alias("bsns_year"))
    else:
        recent = F.array(*(F.lit(str(y)) for y in range(year - n + 1, year + 1)))
        own = companies.join(reported, "company_id").select("corp_code", F.col("year").alias("bsns_year"))
        wanted = own.unionByName(companies.select("corp_code", F.explode(recent).alias("bsns_year"))).distinct()
    return wanted.select("corp_code", "bsns_year", F.explode(F.array(*map(F.lit, codes))).alias("reprt_code"))


def enumerate_targets(universe: DataFrame, periods: str) -> DataFrame:
    """corp_code, period of every company of a list (see landing.universe) and every period of a specification such as 2021-2023 or 2020,2022.

    The periods are few and given, so they are an explode of each company's row. Each pair once; an empty period is none.
    """
    each = F.filter(F.array_distinct(normalize.years(F.lit(periods))), lambda y: y != "")
    return universe.select("corp_code").distinct().select("corp_code", F.explode(each).alias("period"))


def ticker_codes(stocks: DataFrame, master: DataFrame) -> DataFrame:
    """ticker, corp_code, found: the register's code of each stock, null and found = false where the register lacks it.

    Of several entries with one stock code the first by corp_code counts; entries without a stock code are of unlisted companies.
    """
    listed = master.filter(F.trim("stock_code") != "").groupBy(F.trim("stock_code").alias("ticker")).agg(F.min("corp_code").alias("corp_code"))
    return stocks.select("ticker").distinct().join(listed, "ticker", "left").withColumn("found", F.col("corp_code").isNotNull())


def run_batch(queue: DataFrame, outcomes: DataFrame, now: Column, budget: int, max_targets: int = 500, minutes: int = STALE_MINUTES) -> DataFrame:
    """The queue after a batch, with picked: whether a target was in it.

    Stale targets are reset first; the batch is the next pending ones within the budget; outcomes (id, outcome, message, level, chars)
    say how their runs went. A target without an outcome was stopped by a rate limit and stays pending, its attempts as they were.
    """
    ready = reset_stale(queue, now, minutes)
    picked = queue_next(ready, budget, max_targets).select("id", F.lit(True).alias("picked"))
    joined = ready.join(F.broadcast(picked), "id", "left").join(outcomes, "id", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    ran = F.col("picked") & F.col("outcome").isNotNull()
    status, tries = transition(F.col("attempts"), F.col("outcome"), F.col("message"))
    cost = normalize.cost_estimate(F.col("chars"))
    done = ran & (F.col("outcome") == "ok")
    changed = {
        "status": F.when(ran, status).otherwise(F.col("status")), "attempts": F.when(ran, tries).otherwise(F.col("attempts")).cast("int"),
        "last_attempt_at": F.when(ran, now).otherwise(F.col("last_attempt_at")), "last_error": F.when(ran & ~done, F.col("message")).when(done, F.lit(None)).otherwise(F.col("last_error")),
        "escalation_level": F.when(done, F.col("level")).otherwise(F.col("escalation_level")), "cost_estimate_usd": F.when(done, cost).otherwise(F.col("cost_estimate_usd")),
    }
    out = joined.withColumns({"_ran": ran} | changed)
    return out.select(*(c for c in queue.columns), "picked", F.col("_ran").alias("processed"))


def batch_summary(after: DataFrame, budget: int) -> DataFrame:
    """One row of counters over a queue from run_batch."""
    of = lambda status: F.count_if(F.col("processed") & (F.col("status") == status)).alias(status)
    counts = after.agg(
        F.count_if("processed").alias("processed"), of("done"), of("skipped"), of("failed"),
        F.count_if(F.col("picked") & ~F.col("processed")).alias("rate_limit_hits"),
        F.count_if(F.col("status") == "pending").alias("pending_remaining")
    )
    return counts.withColumn("budget_remaining", F.lit(budget) - F.col("processed"))


def escalation_counts(queue: DataFrame) -> DataFrame:
    """escalation_level, n of what is done."""
    return queue.filter("status = 'done'").groupBy("escalation_level").agg(F.count("*").alias("n"))


def recent_changes(stocks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row: stocks created, and stocks delisted, in the last days."""
    since = now - F.make_dt_interval(days=F.lit(days))
    return stocks.agg(F.count_if(F.col("created_at") >= since).alias("created"), F.count_if(F.col("delisted_at") >= since.cast("date")).alias("delisted"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn at random by a seeded hash of their key; reruns agree. A top-n: each task keeps n rows."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_drawn", drawn).orderBy("_drawn", key).limit(n).drop("_drawn")


def universe_of_stocks(stocks: DataFrame) -> DataFrame:
    """corp_code of all stocks that are listed now and linked to the register, each once."""
    return stocks.filter("delisted_at is null and corp_code is not null").select("corp_code").distinct()


CALLS_PER_TARGET = 2
COST_PER_TARGET = 0.25


def enrol_estimate(companies: DataFrame, periods: list[str], queue: DataFrame) -> DataFrame:
    """One row: targets that enrol would add, those that the queue holds already, and what the new ones would cost in calls and dollars."""
    wanted = companies.select("corp_code").distinct().select("corp_code", F.explode(F.array(*map(F.lit, periods))).alias("period"))
    known = queue.select("corp_code", "period").distinct().withColumn("known", F.lit(True))
    counts = wanted.join(known, ["corp_code", "period"], "left").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count("known").alias("skipped"))
    return counts.withColumns({"calls": F.col("added") * CALLS_PER_TARGET, "cost": F.col("added") * COST_PER_TARGET})


def relative_date(spec: Column, today: Column) -> Column:
    """today, yesterday, or an ISO date; null for anything else."""
    said = F.lower(F.trim(spec))
    return F.when(said == "today", today).when(said == "yesterday", F.date_sub(today, 1)).otherwise(said.try_cast("date"))
