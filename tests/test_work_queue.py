"""The queue as a stream's state: it ends as run_batch does, with a restart between, and stale claims end by timers."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import operations
from ledgerloom.streaming import work_queue

NOON = datetime(2024, 1, 15, 12)


@pytest.fixture
def run(spark, tmp_path):
    work_queue.use_store(spark)
    (tmp_path / "in").mkdir()
    number = iter(range(100))

    def land(*events):
        """events: (id, kind, minutes after noon, outcome, message)."""
        lines = [json.dumps({"id": i, "kind": k, "at": (NOON + timedelta(minutes=m)).isoformat(), "outcome": o, "message": t}) for i, k, m, o, t in events]
        at = next(number)
        file = tmp_path / "in" / f"{at:03}.json"
        file.write_text("\n".join(lines))
        os.utime(file, (1_700_000_000 + at,) * 2)  # files are taken in this order

    def go():
        stream = spark.readStream.schema(work_queue.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = work_queue.work_queue(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        query = out.option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        changes = spark.read.schema(work_queue.CHANGES).parquet(str(tmp_path / "out"))
        return changes, {r["id"]: r for r in work_queue.latest(changes).collect()}

    return land, go


OUTCOMES = {1: ("ok", None), 2: ("extract_error", "schema"), 3: ("fetch_error", "no report found"), 4: ("fetch_error", "timeout"), 5: ("fetch_error", "timeout")}


def test_stream_ends_as_a_batch_does(spark, run):
    land, go = run
    land(*((i, "enrol", 0, None, None) for i in (*OUTCOMES, 6, None)))
    land(*((i, "claim", 1, None, None) for i in OUTCOMES))
    _, held = go()
    assert {i: r["status"] for i, r in held.items()} == dict.fromkeys(OUTCOMES, "in_progress") | {6: "pending"}
    # The query has stopped; another one goes on from its checkpoint.
    land(*((i, "outcome", 2, *said) for i, said in OUTCOMES.items()))
    _, held = go()
    queue = spark.createDataFrame([(i, "pending", 0) for i in (*OUTCOMES, 6)], "id long, status string, attempts int").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("last_attempt_at", "timestamp_ntz"), ("last_error", "string"), ("escalation_level", "string"), ("input_chars", "long"), ("cost_estimate_usd", "decimal(8,4)"))}
    )
    outcomes = spark.createDataFrame([(i, *said, "regex", 10) for i, said in OUTCOMES.items()], "id long, outcome string, message string, level string, chars long")
    want = {r["id"]: r for r in operations.run_batch(queue, outcomes, F.lit(NOON + timedelta(minutes=2)).cast("timestamp_ntz"), 5).collect()}
    fields = ("status", "attempts", "last_error")
    assert {i: tuple(r[f] for f in fields) for i, r in held.items()} == {i: tuple(r[f] for f in fields) for i, r in want.items()}
    for k in (3, 5):  # two more timeouts and it has failed
        land((4, "claim", k, None, None))
        land((4, "outcome", k + 1, "fetch_error", "timeout"))
    _, held = go()
    assert (held[4]["status"], held[4]["attempts"]) == ("failed", 3) and (held[5]["status"], held[5]["attempts"]) == ("pending", 1)


def test_a_stale_claim_ends_by_its_timer(run):
    land, go = run
    land((1, "enrol", 0, None, None), (2, "enrol", 0, None, None), (1, "claim", 1, None, None), (2, "claim", 100, None, None))
    land((3, "enrol", 185, None, None))
    _, held = go()
    assert held[1]["status"] == held[2]["status"] == "in_progress"  # within 180 minutes, by the watermark
    land((3, "claim", 200, None, None))
    land((4, "enrol", 201, None, None))
    land((4, "enrol", 202, None, None))
    changes, held = go()
    assert held[1]["status"] == "pending" and held[1]["attempts"] == 0 and held[2]["status"] == held[3]["status"] == "in_progress"
    assert [r["at"] for r in changes.filter("id = 1 and status = 'pending'").orderBy("at").collect()] == [NOON, NOON + timedelta(minutes=181)]
    land((1, "claim", 203, None, None), (1, "outcome", 204, "ok", None))
    _, held = go()
    assert (held[1]["status"], held[1]["attempts"], held[1]["last_error"]) == ("done", 1, None)
