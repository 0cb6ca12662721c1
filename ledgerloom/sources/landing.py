"""Readers of landed raw data. Schemas are given, never inferred, so that codes keep their zeros."""

from __future__ import annotations

import codecs
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.schema import INVESTMENT_ROWS, SHAREHOLDER_ROWS, STATEMENT_ROWS

MASTER = "corp_code string, corp_name string, stock_code string, modify_date string"
PROFILE = "corp_code string, corp_name string, stock_code string, induty_code string"
SHARES = "se string, istc_totqy string, distb_stock_co string"
LISTED = "corp_code string, corp_name string, stock_code string, corp_cls string, report_nm string, rcept_no string, flr_nm string, rcept_dt string, rm string"


def company_master(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a company register in XML; cells are trimmed, missing ones empty."""
    raw = spark.read.format("xml").option("rowTag", "list").schema(MASTER).load(path)
    return raw.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in raw.columns))


def company_master_zip(spark: SparkSession, path: str) -> DataFrame:
    """The same from zip archives that hold the XML."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in (n for n in z.namelist() if n.lower().endswith(".xml")):
                        out += [
                            {
                                c: (item.findtext(c) or "").strip() for c in ("corp_code", "corp_name", "stock_code", "modify_date")
                            } for item in ET.fromstring(z.read(name)).iter("list")
                        ]
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.string()) for c in ("corp_code", "corp_name", "stock_code", "modify_date")]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, MASTER)


def _page(fields: str, more: str = "") -> str:
    return f"status string, message string{more}, list array<struct<{', '.join(f.strip().replace(' ', ': ') for f in fields.split(','))}>>"


def _rows_of(status: Column, rows: Column, empty: tuple[str, ...] | None) -> Column:
    """rows if the status is good, nothing for the statuses in empty (None: for all others), else an error."""
    nothing = F.lit(False) if empty == () else F.lit(True) if empty is None else status.isin(*empty)
    return F.when(status == "000", rows).when(nothing, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("status "), F.coalesce(status, F.lit("null")))))


def listing_pages(spark: SparkSession, path: str, complete: bool = True) -> DataFrame:
    """Filings of all landed pages; pages with another status than 000 or 013 (nothing found) fail the read, and so does a page that is missing.

    complete=False takes what has landed. The check is a table of one row beside the pages.
    """
    pages = spark.read.schema(_page(LISTED, ", page_no int, total_page int")).option("multiLine", True).json(path)
    rows = _rows_of(F.col("status"), F.col("list"), ("013",))
    if complete:
        gaps = missing_pages(spark, path).agg(F.count("*").alias("gaps"), F.min(F.concat_ws("/", "folder", "page_no")).alias("gap"))
        pages = pages.join(F.broadcast(gaps), F.lit(True))
        lacks = F.concat(F.lit("listing lacks "), F.col("gaps").cast("string"), F.lit(" pages, the first is "), F.col("gap"))
        rows = F.when(F.col("gaps") == 0, rows).otherwise(F.raise_error(lacks))
    return pages.select(F.explode(rows).alias("x")).select("x.*")


def missing_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_no of the pages that a listing should have (1 to total_page) but that have not landed. Listings are told apart by their folder."""
    folder = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1)
    pages = spark.read.schema("page_no int, total_page int").option("multiLine", True).json(path).select(folder.alias("folder"), "page_no", "total_page").filter("total_page > 0")
    wanted = pages.groupBy("folder").agg(F.max("total_page").alias("n")).select("folder", F.explode(F.sequence(F.lit(1), "n")).alias("page_no"))
    return wanted.join(pages, ["folder", "page_no"], "left_anti")


KEYS = ("corp_code", "bsns_year", "reprt_code")


def _keyed(spark: SparkSession, path: str, fields: str, empty: tuple[str, ...] | None) -> DataFrame:
    """Rows of landed answers under corp_code=.../bsns_year=.../reprt_code=..., which say what was asked, with ordinal: the place in its answer."""
    own = ", ".join(f.strip() for f in fields.split(",") if f.split()[0] not in KEYS)
    schema = _page(own) + "".join(f", {k} string" for k in KEYS)
    pages = spark.read.schema(schema).option("multiLine", True).option("basePath", path).json(path)
    rows = pages.select(*KEYS, F.posexplode(_rows_of(F.col("status"), F.col("list"), empty)).alias("ordinal", "x"))
    return rows.select(*KEYS, "ordinal", "x.*")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement rows, all cells as strings. 013 means that there are none; any other status but 000 fails the read."""
    pages = spark.read.schema(_page(STATEMENT_ROWS)).option("multiLine", True).json(path)
    return pages.select(F.explode(_rows_of(F.col("status"), F.col("list"), ("013",))).alias("x")).select("x.*")


def report_statements(spark: SparkSession, path: str) -> DataFrame:
    """The same with corp_code, bsns_year and reprt_code of the request, from landed folders."""
    return _keyed(spark, path, STATEMENT_ROWS, ("013",))


def largest_shareholders(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of companies' largest shareholders. Answers with any other status hold nothing."""
    return _keyed(spark, path, SHAREHOLDER_ROWS, None)


def other_investments(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of companies' stakes in others."""
    return _keyed(spark, path, INVESTMENT_ROWS, None)


def share_counts(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of companies' numbers of shares."""
    return _keyed(spark, path, SHARES, None)


def company_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles, one a company: corp_code, corp_name, stock_code, induty_code. Answers with a bad status are left out."""
    raw = spark.read.schema(f"status string, {PROFILE}").option("multiLine", True).json(path)
    return raw.filter("status = '000'").drop("status").dropDuplicates(["corp_code"])


def sector_names(spark: SparkSession, path: str) -> DataFrame:
    """code, name of an industry classification in CSV (code,name)."""
    rows = spark.read.schema("code string, name string").csv(path).select(F.trim("code").alias("code"), F.trim("name").alias("name"))
    return rows.filter("code <> '' and code <> 'code'").dropDuplicates(["code"])


def alias_seeds(spark: SparkSession, path: str) -> DataFrame:
    """group (customers, segments, owners, external_companies), target (a code or a canonical name) and variants of a seed file."""
    entry = "array<struct<corp: string, canonical: string, variants: array<string>>>"
    groups = ("customers", "segments", "owners", "external_companies")
    raw = spark.read.schema(", ".join(f"{g} {entry}" for g in groups)).option("multiLine", True).json(path)
    parts = F.array(*(F.struct(F.lit(g).alias("group"), F.col(g).alias("entries")) for g in groups))
    rows = raw.select(F.explode(parts).alias("p")).select("p.group", F.explode("p.entries").alias("e"))
    return rows.select("group", F.coalesce("e.corp", "e.canonical").alias("target"), "e.variants")


def universe(spark: SparkSession, path: str) -> DataFrame:
    """corp_code, line of a list of eight-digit codes, one a line, each code where it stands first; # starts a comment. Any other line fails the read."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value")).select(
        (F.col("at") + 1).alias("line"), F.trim(F.regexp_replace("value", "#.*", "")).alias("code")
    )
    bad = F.raise_error(F.concat(F.lit("bad code in line "), F.col("line").cast("string"), F.lit(": "), "code"))
    checked = F.when(F.col("code").rlike(r"^\d{8}$"), F.col("code")).otherwise(bad)
    return lines.filter("code <> ''").select(checked.alias("corp_code"), "line").groupBy("corp_code").agg(F.min("line").alias("line"))


def filing_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, html, problem: the business section of the main report in each zipped filing, or why there is none.

    The main report is the first XML whose first 4 KiB name the annual report's code and title, else the largest; the
    section is the first whose title's note has the form D-...-2-0-0, else the last with the section's name and numeral.
    Markup that is not well-formed is read by `loose_sections`. Members are unpacked piece by piece: a task holds the
    archive, one section and the best one so far, and ends with the noted one, whatever the size of the report.
    """

    def section(content: bytes) -> tuple[str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = [i for i in z.infolist() if i.filename.lower().endswith(".xml")]
                if not found:
                    return None, "no XML in the archive"
                main = next((i for i in found if _is_annual(z, i)), max(found, key=lambda i: i.file_size))
                try:
                    with z.open(main) as member:
                        chosen = business_section(pulled_sections(member))
                except ET.ParseError:
                    with z.open(main) as member:
                        chosen = business_section(loose_sections(member))
        except (zipfile.BadZipFile, EOFError, zlib.error):
            return None, "no zip archive"
        return (None, "no business section") if chosen is None else (f"<html><body>{chosen}</body></html>", None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One filing at a time: contents are not all turned into Python objects at once.
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                html, problem = section(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([html], pa.string()), pa.array([problem], pa.string())], ["path", "html", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, html string, problem string")


def _is_annual(z: zipfile.ZipFile, member: zipfile.ZipInfo) -> bool:
    with z.open(member) as f:
        head = f.read(4096)
    return b'ACODE="11011"' in head and "사업보고서".encode() in head


def business_section(parts: Iterable[tuple[str, str, str]]) -> str | None:
    """The markup of the business section among (title's words, title's note, markup)."""
    named = None
    for words, note, body in parts:
        if note.startswith("D-") and note.endswith("-2-0-0"):
            return body
        if "사업의 내용" in words and ("II" in words or "Ⅱ" in words):
            named = body
    return named


def pulled_sections(source: IO[bytes]) -> Iterator[tuple[str, str, str]]:
    """(title's words, title's note, markup) of each SECTION-1 of well-formed markup; what has been read is let go, at whatever depth it stands."""
    open_: list[ET.Element] = []
    depth = 0  # of sections
    for event, node in ET.iterparse(source, events=("start", "end")):
        if event == "start":
            open_.append(node)
            depth += node.tag == "SECTION-1"
            continue
        open_.pop()
        depth -= node.tag == "SECTION-1"
        if depth:
            continue
        for part in node.iter("SECTION-1") if node.tag == "SECTION-1" else ():
            title = part.find("TITLE")
            words, note = ("".join(title.itertext()), title.get("AASSOCNOTE") or "") if title is not None else ("", "")
            yield words, note, ET.tostring(part, encoding="unicode")
        if open_:
            open_[-1].remove(node)


EDGE = re.compile(r"<SECTION-1(?!\w)|</SECTION-1\s*>")
EDGE_MAX = 64


def loose_sections(source: IO[bytes], step: int = 1 << 20) -> Iterator[tuple[str, str, str]]:
    """(title's words, title's note, markup) of each SECTION-1 in markup that need not be well-formed: a section ends where the next begins."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held: list[str] | None = None  # the open section's text
    rest, piece = "", b"more"
    while piece:
        piece = source.read(step)
        rest += decode(piece, not piece)
        # A tag may be cut where a piece ends: the last characters wait for the next piece.
        safe, at = max(0, len(rest) - EDGE_MAX) if piece else len(rest), 0
        for edge in EDGE.finditer(rest):
            if edge.start() >= safe:
                break
            if held is not None:
                yield _titled("".join([*held, rest[at : edge.start()]]))
            held, at = None if edge[0].startswith("</") else [], edge.start()
        if held is not None:
            held.append(rest[at:safe])
        rest = rest[safe:]
    if held is not None:
        yield _titled("".join(held))


def _titled(body: str) -> tuple[str, str, str]:
    title = re.search(r"<TITLE\b([^>]*)>(.*?)</TITLE\s*>", body, re.DOTALL)
    note = re.search(r'AASSOCNOTE\s*=\s*"([^"]*)"', title[1]) if title else None
    return re.sub(r"<[^>]*>", "", title[2]) if title else "", note[1] if note else "", body
