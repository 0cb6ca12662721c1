"""Large filings read piece by piece, and the ledger of landed files."""

import io
import json
import re
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import landing, ledger

SECTION = '<SECTION-1><TITLE{note}>{title}</TITLE><P>{body}</P></SECTION-1>'


def plain_loose(markup):
    out = []
    for body in re.findall(r"<SECTION-1\b.*?(?=<SECTION-1\b|</SECTION-1\s*>|\Z)", markup, re.DOTALL):
        title = re.search(r"<TITLE\b([^>]*)>(.*?)</TITLE\s*>", body, re.DOTALL)
        note = re.search(r'AASSOCNOTE\s*=\s*"([^"]*)"', title[1]) if title else None
        out.append((re.sub(r"<[^>]*>", "", title[2]) if title else "", note[1] if note else "", body))
    return out


@pytest.mark.parametrize("step", [1, 7, 65, 1 << 20])
@pytest.mark.parametrize("markup", [
    "", "no section", "<SECTION-1", "<SECTION-10>x</SECTION-10>", "<SECTION-1>", '<A><SECTION-1><TITLE AASSOCNOTE = "D-0">가 <B>나</B></TITLE>다 & 라<SECTION-1>second</SECTION-1 >between<SECTION-1 X="1">third',
    "가나다" * 60 + "<SECTION-1>" + "라" * 300 + "</SECTION-1>" + "<SECTION-1><TITLE>t</TITLE></SECTION-1>",
])
def test_loose_sections_in_pieces(markup, step):
    assert list(landing.loose_sections(io.BytesIO(markup.encode()), step)) == plain_loose(markup)


def test_pulled_sections():
    inner = "<SECTION-1><TITLE>in</TITLE></SECTION-1>"
    doc = f'<D><H>x</H><B><SECTION-1><TITLE AASSOCNOTE="n">a<I>b</I></TITLE>{inner}</SECTION-1></B>tail<SECTION-1/></D>'
    got = list(landing.pulled_sections(io.BytesIO(doc.encode())))
    assert [g[:2] for g in got] == [("ab", "n"), ("in", ""), ("", "")] and inner in got[0][2]


def test_large_member_in_bounded_memory():
    filler = SECTION.format(note="", title="I. other", body="<P>filler text</P>" * 2000).encode()
    part = SECTION.format(note="", title="II. 사업의 내용", body="본문").encode()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z, z.open("main.xml", "w") as f:
        f.write(b"<D>" + part)
        for _ in range(600):
            f.write(filler)
        f.write(b"</D>")
    with zipfile.ZipFile(held) as z:
        assert z.infolist()[0].file_size > 20_000_000
        for read in (landing.pulled_sections, landing.loose_sections):
            tracemalloc.start()
            with z.open("main.xml") as member:
                assert "본문" in landing.business_section(read(member))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 12_000_000


def test_filings_whole_loose_and_bad(spark, tmp_path):
    head = '<DOC ACODE="11011"><A>사업보고서</A>'
    noted = head + SECTION.format(note="", title="II. 사업의 내용", body="old") + SECTION.format(note=' AASSOCNOTE="D-0-2-0-0"', title="x", body="noted") + "</DOC>"
    loose = head + SECTION.format(note="", title="Ⅱ. 사업의 내용", body="a & b <br>")
    files = {"noted": {"big.xml": "<x>" + "y" * 9000 + "</x>", "m.XML": noted}, "loose": {"m.xml": loose}, "none": {"a.txt": "x"}, "other": {"a.xml": "<a/>"}}
    for name, members in files.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for member, body in members.items():
                z.writestr(member, body)
    (tmp_path / "bad.zip").write_text("no archive")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "noted.zip").read_bytes()[:-30])
    got = {r["path"].rsplit("/", 1)[1]: r for r in landing.filing_documents(spark, str(tmp_path)).collect()}
    assert "noted" in got["noted.zip"]["html"] and "old" not in got["noted.zip"]["html"] and "a & b <br>" in got["loose.zip"]["html"]
    assert {k: r["problem"] for k, r in got.items() if r["problem"]} == {
        "none.zip": "no XML in the archive", "other.zip": "no business section", "bad.zip": "no zip archive", "cut.zip": "no zip archive"
    }


def test_ledger_reads_changed_files_alone(spark, tmp_path):
    land = tmp_path / "land"
    for i in range(3):
        (land / f"k={i}").mkdir(parents=True)
        (land / f"k={i}" / "a.json").write_text(json.dumps({"x": i}))
    read = lambda names: spark.read.schema("x int").json(names)
    none = spark.createDataFrame([], ledger.LEDGER)
    rows, held = ledger.read_changed(spark, str(land), none, read)
    assert sorted(r["x"] for r in rows.collect()) == [0, 1, 2] and held.count() == 3
    held.write.parquet(str(tmp_path / "ledger"))
    stored = spark.read.schema(ledger.LEDGER).parquet(str(tmp_path / "ledger"))
    assert ledger.read_changed(spark, str(land), stored, read)[0] is None
    (land / "k=1" / "a.json").write_text(json.dumps({"x": 100}))
    (land / "k=3").mkdir()
    (land / "k=3" / "a.json").write_text(json.dumps({"x": 3}))
    rows, after = ledger.read_changed(spark, str(land), stored, read)
    assert sorted(r["x"] for r in rows.collect()) == [3, 100] and after.count() == 4
    assert ledger.read_changed(spark, str(land), after, read)[0] is None


def test_fingerprint(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, "id").alias("s"), F.create_map(F.lit("a"), "id", F.lit("b"), F.lit(1)).alias("m"))
    turned = df.select(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.col("id")).cast("map<string,bigint>").alias("m"), "s", "id").orderBy(F.desc("id")).repartition(7)
    assert ledger.same_table(df.withColumn("m", F.col("m").cast("map<string,bigint>")), turned)
    assert not ledger.same_table(df, df.union(df.limit(1))) and not ledger.same_table(df, df.filter("id > 0")) and not ledger.same_table(df, df.withColumnRenamed("s", "t"))
    one = spark.createDataFrame([("x", None)], "a string, b string")
    assert not ledger.same_table(one, one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert ledger.same_table(df.limit(0), df.limit(0)) and ledger.fingerprint(df.limit(0)).first()["n"] == 0
