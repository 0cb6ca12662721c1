import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import landing, sinks
from ledgerloom.streaming import incremental

XML = "<result><list><corp_code>00126380</corp_code><corp_name> 삼성 </corp_name><stock_code>005930</stock_code><modify_date>20240101</modify_date></list><list><corp_code>00000001</corp_code></list></result>"


def test_master(spark, tmp_path):
    (tmp_path / "m.xml").write_text(XML)
    want = {("00126380", "삼성", "005930", "20240101"), ("00000001", "", "", "")}
    assert set(map(tuple, landing.company_master(spark, str(tmp_path / "m.xml")).collect())) == want
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("CORPCODE.xml", XML)
    assert set(map(tuple, landing.company_master_zip(spark, str(tmp_path / "m.zip")).collect())) == want


def test_filing(spark, tmp_path):
    main = '<DOC ACODE="11011"><A>사업보고서</A><SECTION-1><TITLE>I. 회사</TITLE></SECTION-1><SECTION-1><TITLE AASSOCNOTE="D-0-2-0-0">II. 사업의 내용</TITLE><P>본문</P></SECTION-1></DOC>'
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("big.xml", "<x>" + "y" * 9000 + "</x>")
        z.writestr("main.xml", main)
    assert "본문" in landing.filing_documents(spark, str(tmp_path / "f.zip")).first()["html"]


def test_pages_and_universe(spark, tmp_path):
    row = {
        "corp_code": "00000001", "corp_name": "a", "stock_code": "", "corp_cls": "E", "report_nm": "사업보고서 (2023.12)", "rcept_no": "1", "flr_nm": "",
        "rcept_dt": "20240301", "rm": ""
    }
    (tmp_path / "p1.json").write_text(json.dumps({"status": "000", "message": "", "page_no": 1, "total_page": 2, "list": [row]}))
    (tmp_path / "p2.json").write_text(json.dumps({"status": "013", "message": "", "page_no": 2, "total_page": 2}))
    assert landing.listing_pages(spark, f"{tmp_path}/p*.json").count() == 1
    (tmp_path / "u.txt").write_text("# all\n00000001 # one\n00000001\n\n00000002\n")
    assert {tuple(r) for r in landing.universe(spark, str(tmp_path / "u.txt")).collect()} == {("00000001", 2), ("00000002", 5)}
    (tmp_path / "bad.txt").write_text("123\n")
    with pytest.raises(Exception, match="bad code in line 1"):
        landing.universe(spark, str(tmp_path / "bad.txt")).collect()


def test_incremental_stream(spark, tmp_path):
    land, known = tmp_path / "land", tmp_path / "known"
    land.mkdir()
    (known / "batch_id=-1").mkdir(parents=True)
    spark.createDataFrame([("3",)], "rcept_no string").write.mode("overwrite").parquet(str(known / "batch_id=-1"))
    members = spark.createDataFrame([("1",)], "corp_code string")
    got = []

    def run(*rows):
        (land / f"{len(list(land.iterdir()))}.json").write_text("\n".join(json.dumps({"corp_code": c, "report_nm": n, "rcept_no": r}) for c, n, r in rows))
        incremental.run_incremental(incremental.listing_stream(spark, str(land)), members, str(known), "annual", lambda df, _: got.extend(r["rcept_no"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()

    run(("1", "annual", "1"), ("1", "annual", "1"), ("1", "quarterly", "2"), ("1", "annual", "3"), ("9", "annual", "4"))
    run(("1", "annual", "1"), ("1", "annual", "5"))
    assert got == ["1", "5"]


def test_windows_on_a_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count() == incremental.windowed_counts(events).agg(F.sum("n")).first()[0]


def test_export(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "company"), ("a", "company")], "id string, kind string")
    edges = spark.createDataFrame([("a", "P", "b", None)], "subject_id string, predicate string, object_id string, period string")
    facts = spark.createDataFrame(
        [("a", "2024", "FY", "CFS", "revenue", 1)],
        "company_id string, bsns_year string, fiscal_period string, fs_div string, metric_key string, amount int"
    )
    sinks.export_graph(nodes, edges, facts, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).filter("predicate = 'REPORTS'").first()["object_id"] == "metric:revenue"
    assert spark.read.json(str(tmp_path / "g/nodes")).count() == 2


def test_bad_answers(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps({"status": "013", "message": "none"}))
    assert landing.statements(spark, str(tmp_path / "s1.json")).collect() == []
    (tmp_path / "s2.json").write_text(json.dumps({"status": "020", "message": "limit"}))
    with pytest.raises(Exception, match="status 020"):
        landing.statements(spark, str(tmp_path / "s2.json")).collect()
    for i, total in ((1, 3), (3, 3)):
        (tmp_path / "list").mkdir(exist_ok=True)
        (tmp_path / "list" / f"{i}.json").write_text(json.dumps({"status": "000", "page_no": i, "total_page": total, "list": []}))
    assert [r["page_no"] for r in landing.missing_pages(spark, str(tmp_path / "list")).collect()] == [2]


def test_bad_filings(spark, tmp_path):
    broken = '<DOC ACODE="11011">사업보고서<SECTION-1><TITLE>Ⅰ. 개요</TITLE></SECTION-1><SECTION-1><TITLE AASSOCNOTE="D-0-2-0-0">Ⅱ. 사업의 내용</TITLE><P>본문 & 끝<BR></SECTION-1></DOC>'
    for name, text in (("a", broken), ("b", "<DOC/>")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("m.xml", text)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("m.txt", "x")
    (tmp_path / "d.zip").write_bytes(b"no zip")
    got = {r["path"][-5]: (r["html"], r["problem"]) for r in landing.filing_documents(spark, f"{tmp_path}/*.zip").collect()}
    assert "본문 & 끝" in got["a"][0] and got["a"][1] is None
    assert {k: v[1] for k, v in got.items() if k != "a"} == {"b": "no business section", "c": "no XML in the archive", "d": "no zip archive"}


def test_seeds_and_names(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"customers": [{"corp": "00000001", "variants": ["A", "B"]}], "owners": [{"canonical": "Kim", "variants": ["K"]}]}))
    assert {
        (r["group"], r["target"], tuple(r["variants"])) for r in landing.alias_seeds(spark, str(tmp_path / "a.json")).collect()
    } == {("customers", "00000001", ("A", "B")), ("owners", "Kim", ("K",))}
    (tmp_path / "k.csv").write_text("code,name\n264,통신장비\n 26 ,전자\n")
    assert {tuple(r) for r in landing.sector_names(spark, str(tmp_path / "k.csv")).collect()} == {("264", "통신장비"), ("26", "전자")}
    (tmp_path / "p.json").write_text(json.dumps({"status": "000", "corp_code": "00000001", "corp_name": "a", "stock_code": "", "induty_code": "264"}))
    assert landing.company_profiles(spark, str(tmp_path / "p.json")).first()["induty_code"] == "264"
    master = spark.createDataFrame([("1",), ("2",)], "corp_code string")
    assert sinks.sync_master(master, str(tmp_path / "master")) == 2


def test_a_poisoned_report_does_not_stop_the_batch(spark, tmp_path):
    members = spark.createDataFrame([("1",)], "corp_code string")
    (tmp_path / "in").mkdir()
    paths = str(tmp_path / "known"), "annual"
    handed, bad = [], {"2", "4"}

    def land(number, *names):
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps({"corp_code": "1", "report_nm": "annual", "rcept_no": n}) for n in names))

    def handle(reports, batch_id):
        poison = list(bad)

        def run(report):
            if report["rcept_no"] in poison:
                raise ValueError("poisoned")
            return {"size": len(report["report_nm"])}

        done = incremental.guarded(reports, run, "size long").persist()
        handed.append(sorted(r["rcept_no"] for r in done.collect()))
        assert all(r["done"]["size"] == 6 for r in done.filter("error is null").collect())
        return done.filter("error is not null").select("rcept_no", "error")

    def go():
        stream = incremental.listing_stream(spark, str(tmp_path / "in"))
        incremental.run_incremental(stream, members, *paths, handle, str(tmp_path / "cp"), str(tmp_path / "failed")).awaitTermination()

    known = lambda: sorted(r["rcept_no"] for r in spark.read.parquet(str(tmp_path / "known")).collect())
    land(0, "1", "2", "3")
    go()
    assert handed == [["1", "2", "3"]] and known() == ["1", "3"]
    land(1, "4", "2")  # listed again and tried again, once
    go()
    assert handed[1] == ["2", "4"] and known() == ["1", "3"]
    bad.discard("4")
    incremental.retry_failed(spark, members, *paths, handle, str(tmp_path / "failed"))
    assert handed[2] == ["2", "4"] and known() == ["1", "3", "4"]
    bad.clear()
    incremental.retry_failed(spark, members, *paths, handle, str(tmp_path / "failed"))
    assert handed[3] == [] and known() == ["1", "3", "4"]  # three attempts are all that a report gets
    failed = {(r["rcept_no"], r["attempts"]): r["error"] for r in spark.read.parquet(str(tmp_path / "failed")).collect()}
    assert set(failed) == {("2", 1), ("2", 2), ("2", 3), ("4", 1)} and set(failed.values()) == {"ValueError: poisoned"}


def test_a_missing_page_fails_the_listing(spark, tmp_path):
    def page(folder, number, total, *names):
        (tmp_path / "list" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "list" / folder / f"{number}.json").write_text(json.dumps({"status": "000", "page_no": number, "total_page": total, "list": [{"rcept_no": n} for n in names]}))

    page("day=1", 1, 1, "a")
    page("day=2", 1, 3, "b")
    page("day=2", 3, 3, "d")
    read = lambda **how: sorted(r["rcept_no"] for r in landing.listing_pages(spark, str(tmp_path / "list"), **how).collect())
    with pytest.raises(Exception, match="listing lacks 1 pages, the first is .*day=2/2"):
        read()
    assert read(complete=False) == ["a", "b", "d"]
    page("day=2", 2, 3, "c")
    assert read() == ["a", "b", "c", "d"]
