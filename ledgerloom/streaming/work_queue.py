"""The work queue as keyed state of a stream: each target's row is state, runs' outcomes are events, stale runs end by timers.

A target (id) is enrolled by its first event and moves as transition() says: pending, in_progress once it is claimed, then done,
skipped or failed, or pending again. A claim sets a timer; if neither an outcome nor another claim comes within the limit, the
target is pending again, as reset_stale() would find. State and timers are in the stream's checkpoint, so a restart goes on
where the query stopped.

Needs the RocksDB state store (STORE), as transformWithState does. Events of a target are taken batch by
batch, in a batch in the order of at, then of their kinds (enrol, claim, outcome). Defined results: an event of a target that was never enrolled enrols it; outcomes for a target
that is not in progress change nothing but attempts, as a late answer is an answer; rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.operations import MAX_ATTEMPTS, STALE_MINUTES

EVENTS = "id long, kind string, at timestamp, outcome string, message string"
STATE = "status string, attempts int, last_attempt_at timestamp, last_error string"
CHANGES = f"id long, at timestamp, {STATE}"
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("enrol", "claim", "outcome")


def next_status(attempts: int, outcome: str | None, message: str | None) -> str:
    """What operations.transition() gives, for one row; attempts counts this run."""
    if outcome == "ok":
        return "done"
    if outcome == "fetch_error":
        if "no report" in (message or ""):
            return "skipped"
        if attempts < MAX_ATTEMPTS:
            return "pending"
    return "failed"


class Targets(StatefulProcessor):
    """One target a key. Emits a row for each change."""

    def __init__(self, minutes: int = STALE_MINUTES):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("target", STATE)
        self.claimed = handle.getValueState("claimed", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows))
        events["place"] = events["kind"].map(KINDS.index)
        state = self.held.get() if self.held.exists() else ("pending", 0, None, None)
        out = []
        for e in events.sort_values(["at", "place", "outcome", "message"]).itertuples():
            status, attempts, last, error = state
            if e.kind == "claim" and status == "pending":
                state = "in_progress", attempts, e.at.to_pydatetime(), error
            elif e.kind == "outcome":
                tries = attempts + 1
                status = next_status(tries, e.outcome, e.message) if status == "in_progress" else status
                state = status, tries, e.at.to_pydatetime(), None if e.outcome == "ok" else e.message
            out.append((key[0], e.at, *state))
        self.held.update(state)
        self._set_timer(state)
        yield _changes(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, last, error = self.held.get()
        self.claimed.clear()
        if status != "in_progress":
            return
        state = "pending", attempts, last, error
        self.held.update(state)
        yield _changes([(key[0], datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None), *state)])

    def close(self) -> None:
        pass

    def _set_timer(self, state: tuple) -> None:
        if self.claimed.exists():
            self.handle.deleteTimer(self.claimed.get()[0])
            self.claimed.clear()
        if state[0] == "in_progress":
            until = int(pd.Timestamp(state[2]).tz_localize("UTC").timestamp() * 1000) + self.minutes * 60_000
            self.handle.registerTimer(until)
            self.claimed.update((until,))


def _changes(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["id", "at", "status", "attempts", "last_attempt_at", "last_error"])
    return made.astype({"id": "int64", "attempts": "int32", "at": "datetime64[ns]", "last_attempt_at": "datetime64[ns]"})


def work_queue(events: DataFrame, minutes: int = STALE_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The changes of all targets (CHANGES) from a stream of EVENTS. Timers follow event time, so a replay gives the same changes."""
    ready = events.filter("id is not null").withWatermark("at", late)
    return ready.groupBy("id").transformWithStateInPandas(Targets(minutes), CHANGES, "Append", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """id and state of each target: its last change. Of changes at one time the one after more attempts, then the one furthest on."""
    order = F.struct("at", "attempts", F.col("status") != "pending", F.col("status") != "in_progress")
    best = changes.groupBy("id").agg(F.max_by(F.struct("status", "attempts", "last_attempt_at", "last_error"), order).alias("s"))
    return best.select("id", "s.*")


def use_store(spark: SparkSession) -> None:
    spark.conf.set(*STORE)
