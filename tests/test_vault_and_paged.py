import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import projection, seeds
from ledgerloom.sources import paged, vault

NOTES = "kind string, node_id string, name string, note string"


def files_of(path):
    folder, n = vault.current_notes(path)
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names}, n


def test_notes_of_one_name_get_files_of_their_own(spark, tmp_path):
    rows = [("company", "company:1", "삼성", "a"), ("company", "company:2", "삼성", "b"), ("company", "company:3", "SK", "c"), ("company", "company:4", "sk", "d")]
    rows += [("person", "person:1", "삼성", "e"), ("region", "region:1", "..", "f"), ("region", "region:2", "", "g"), ("sector", "sector:1", None, "h")]
    vault.write_notes(projection.note_files(spark.createDataFrame(rows, NOTES)), str(tmp_path))
    got, n = files_of(str(tmp_path))
    assert n == len(got) == 8 and sorted(got.values()) == list("abcdefgh")
    assert got["companies/삼성.md"] == "a" and got["companies/SK.md"] == "c" and got["people/삼성.md"] == "e"
    assert {k.split("/")[0] for k in got} == {"companies", "people", "regions", "sectors"} and len({k.lower() for k in got}) == 8
    vault.write_notes(projection.note_files(spark.createDataFrame(rows[:2], NOTES)), str(tmp_path))
    assert sorted(files_of(str(tmp_path))[0].values()) == ["a", "b"]
    vault.write_notes(projection.note_files(spark.createDataFrame([], NOTES)), str(tmp_path))
    assert files_of(str(tmp_path)) == ({}, 0)


def test_aborted_notes_leave_the_former_ones(spark, tmp_path):
    good = spark.createDataFrame([("people", "a", "x")], "folder string, name string, note string")
    vault.write_notes(good, str(tmp_path))
    before, versions = vault.current_notes(str(tmp_path)), os.listdir(tmp_path)
    many = spark.range(40).select(F.lit("people").alias("folder"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") < 39, "y").alias("note")).repartition(4)
    for bad in (many, good.withColumn("name", F.lit("../a"))):
        with pytest.raises(Exception, match="no file can be made"):
            vault.write_notes(bad, str(tmp_path))
        assert vault.current_notes(str(tmp_path)) == before and sorted(os.listdir(tmp_path)) == sorted(versions)
    assert files_of(str(tmp_path))[0] == {"people/a.md": "x"}


def test_person_notes(spark):
    nodes = spark.createDataFrame([("company:1", "company", "A/S"), ("company:2", "company", None), ("person:1", "person", 'Kim "K"'), ("person:2", "person", "Lee")], "id string, kind string, label string")
    edges = spark.createDataFrame([
        ("person:1", "OWNS_STAKE_IN", "company:1", "2022", (10.0,)), ("person:1", "OWNS_STAKE_IN", "company:1", "2023", (12.5,)), ("person:1", "OWNS_STAKE_IN", "company:2", "2023", (None,)),
        ("person:1", "OWNS_STAKE_IN", "company:9", "2023", (1.0,)), ("person:2", "SELLS_TO", "company:1", "2023", (1.0,)),
    ], "subject_id string, predicate string, object_id string, period string, qualifier struct<stake_pct: double>")
    got = {r["node_id"]: r["note"] for r in projection.person_notes(nodes, edges).collect()}
    assert got["person:1"] == '---\ntype: "person"\nname: "Kim \\"K\\""\nowned_count: 2\ntags: [person]\n---\n# Kim "K"\n\n\n## 보유 회사 (2)\n\n- [[A S]] — 12.5%\n- [[company 2]]\n'
    assert got["person:2"].endswith("## 보유 회사 (0)\n\n- (없음)\n")


def test_core_seeds(spark):
    nodes, edges = seeds.core_seeds(spark)
    assert {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"sector": 3, "region": 6, "company": 3, "stock": 3}
    assert edges.count() == 6 and edges.join(nodes, edges.object_id == nodes.id, "left_anti").isEmpty()


def page(root, listing, number, total, *codes, status="000"):
    folder = root / listing
    folder.mkdir(parents=True, exist_ok=True)
    rows = [{"corp_code": c, "rcept_no": f"{listing}-{c}", "report_nm": "r"} for c in codes]
    (folder / f"page-{number}.json").write_text(json.dumps({"status": status, "page_no": number, "total_page": total, "list": rows}))


def test_paged_listing(spark, tmp_path):
    page(tmp_path, "20240301", 1, 2, "1", "2")
    page(tmp_path, "20240301", 2, 2, "3")
    page(tmp_path, "20240302", 1, 0, status="013")
    df = paged.paged_listing(spark, str(tmp_path))
    assert sorted((r["listing"], r["page_no"], r["corp_code"], r["stock_code"]) for r in df.collect()) == [("20240301", 1, "1", None), ("20240301", 1, "2", None), ("20240301", 2, "3", None)]
    assert df.rdd.getNumPartitions() == 3
    page(tmp_path, "20240303", 1, 3, "4")
    page(tmp_path, "20240303", 3, 3, "6")
    with pytest.raises(Exception, match="lacks page 2 of 3"):
        paged.paged_listing(spark, str(tmp_path)).collect()
    page(tmp_path, "20240303", 2, 3, "5", status="020")
    with pytest.raises(Exception, match="status 020"):
        paged.paged_listing(spark, str(tmp_path)).collect()


def test_paged_stream_hands_on_whole_listings(spark, tmp_path):
    land, out, checkpoint = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = paged.paged_stream(spark, str(land)).select("listing", "corp_code").writeStream.format("parquet").option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start(out).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("listing string, corp_code string").parquet(out).collect())

    page(land, "20240301", 1, 1, "1")
    page(land, "20240302", 1, 2, "2")
    page(land, "20240303", 1, 1, "4")
    assert run() == [("20240301", "1")]
    assert run() == [("20240301", "1")]
    page(land, "20240302", 2, 2, "3")
    assert run() == [("20240301", "1"), ("20240302", "2"), ("20240302", "3"), ("20240303", "4")]
