"""Snapshots of several tables: one commit, untouched buckets, conflicts, and readers beside a writer that dies."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import upsert
from ledgerloom.plans import runs
from ledgerloom.sources import snapshots


def some_nodes(spark, *labels):
    return spark.createDataFrame([(f"n{i}", "segment", label, None) for i, label in labels], schema.NODES)


def some_edges(spark, *shares):
    empty = spark.createDataFrame([], schema.EDGES)
    rows = spark.createDataFrame([(f"company:{i}", "HAS_SEGMENT", f"n{i}", "2024", share) for i, share in shares], "subject_id string, predicate string, object_id string, period string, confidence double")
    return rows.unionByName(empty, allowMissingColumns=True).select(*empty.columns)


def labels(store, version=None):
    return {r["id"]: r["label"] for r in store.read("nodes", version).collect()}


@pytest.fixture
def store(spark, tmp_path):
    made = snapshots.Store(spark, f"file://{tmp_path}/store")
    tx = made.begin()
    tx.put("nodes", some_nodes(spark, *((i, "old") for i in range(40))), buckets=8)
    tx.put("edges", some_edges(spark, *((i, 1.0) for i in range(40))), buckets=8)
    assert tx.commit() == 1
    return made


def test_a_writer_that_dies_between_two_tables_leaves_the_snapshot(spark, store):
    with pytest.raises(RuntimeError):
        tx = store.begin()
        snapshots.upsert_model(tx, nodes=some_nodes(spark, (1, "new"), (99, "new")))
        raise RuntimeError("the driver is lost before edges are written")
    assert store.version() == 1 and set(labels(store).values()) == {"old"} and store.read("edges").count() == 40
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # lost while a table is being written
        tx = store.begin()
        tx.put("edges", some_edges(spark, (1, 2.0)).withColumn("confidence", F.col("confidence") / F.lit(0)))
    assert store.version() == 1 and store.read("edges").count() == 40
    tx = store.begin()  # and the run is made once more
    snapshots.upsert_model(tx, nodes=some_nodes(spark, (1, "new"), (99, "new")), edges=some_edges(spark, (1, 9.0)))
    assert set(labels(store).values()) == {"old"}  # nothing shows before the commit
    assert tx.commit() == 2
    assert labels(store)["n1"] == labels(store)["n99"] == "new" and len(labels(store)) == 41
    assert {r["confidence"] for r in store.read("edges").filter("subject_id = 'company:1'").collect()} == {9.0}
    assert set(labels(store, 1).values()) == {"old"} and len(labels(store, 1)) == 40  # the former snapshot can still be read


def test_files_of_untouched_buckets_keep_their_names(spark, store):
    before = store.manifest()["tables"]
    tx = store.begin()
    touched = snapshots.upsert_model(tx, nodes=some_nodes(spark, (3, "new")))["nodes"]
    tx.commit()
    after = store.manifest()["tables"]
    assert len(touched) == 1 and len(before["nodes"]["files"]) == 8
    assert {b for b in after["nodes"]["files"] if after["nodes"]["files"][b] != before["nodes"]["files"][b]} == touched
    assert after["edges"] == before["edges"]


def test_an_upsert_by_buckets_equals_one_over_the_whole_table(spark, store):
    batch = some_edges(spark, (3, 5.0), (3, 6.0), (50, 7.0)).withColumn("source_ref", F.col("confidence").cast("string"))
    whole = upsert.upsert_edges(store.read("edges"), batch, [F.desc("source_ref")])
    want = snapshots.fingerprint(whole).first()
    tx = store.begin()
    snapshots.upsert_model(tx, edges=batch)
    tx.commit()
    assert snapshots.fingerprint(store.read("edges")).first() == want and want["n"] == 41
    assert snapshots.fingerprint(store.read("edges").repartition(7)).first() == want
    assert snapshots.fingerprint(store.read("edges").filter("subject_id <> 'company:3'")).first() != want


def test_two_writers(spark, store):
    one, two, three = store.begin(), store.begin(), store.begin()
    buckets = {}
    for i in range(40):
        own = some_nodes(spark, (i, "x")).select(snapshots.Transaction._bucket(store.manifest()["tables"]["nodes"])).first()[0]
        buckets.setdefault(own, i)
        if len(buckets) > 1:
            break
    a, b = buckets.values()
    snapshots.upsert_model(one, nodes=some_nodes(spark, (a, "one")))
    snapshots.upsert_model(two, nodes=some_nodes(spark, (b, "two")))
    snapshots.upsert_model(three, nodes=some_nodes(spark, (a, "three")))
    assert one.commit() == 2 and two.commit() == 3  # other buckets: the second goes on top
    assert labels(store)[f"n{a}"] == "one" and labels(store)[f"n{b}"] == "two"
    with pytest.raises(snapshots.Conflict):
        three.commit()
    whole = store.begin()
    whole.put("nodes", whole.read("nodes").withColumn("label", F.lit("all")))
    late = store.begin()
    snapshots.upsert_model(late, nodes=some_nodes(spark, (b, "late")))
    late.commit()
    with pytest.raises(snapshots.Conflict):
        whole.commit()
    assert labels(store)[f"n{b}"] == "late"
    assert not store.files.create(store._at(2), "{}")  # a number is given once


def test_the_pipeline_commits_once(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/model")
    nodes = spark.createDataFrame([("company:00000007", "company", "Seven", {"dart_code": "00000007"})], schema.NODES)
    tx = store.begin()
    for name, table in (("nodes", nodes), ("edges", spark.createDataFrame([], schema.EDGES)), ("facts", spark.createDataFrame([], schema.FACTS)), ("reports", spark.createDataFrame([], schema.REPORTS))):
        tx.put(name, table, buckets=2)
    tx.commit()
    said = spark.createDataFrame([("00000007", "r1", ("2024", [("chips", 50.0, None, [])], [], []))], f"company_code string, rcept_no string, record {schema.EXTRACTION}")
    tx = store.begin()
    tables = {name: tx.read(name) for name in ("nodes", "edges", "facts", "reports")}
    runs.run_pipeline(tables, {"extractions": said}, 2026, skip=("financials", "equity", "export"), publish=tx.publish)
    assert store.read("edges").count() == 0
    tx.commit()
    assert store.read("edges").count() == 1 and store.read("nodes").count() == 2 and store.read("reports").count() == 1
