"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

A-Z is lower-cased; words are runs of 0-9, a-z and all characters from U+0080 on. An item's windows are its runs of
`span` consecutive words; an item of fewer words, but not none, is one window. The automaton holds every window as
" word word ... " and reads each document's normalised text once; hits are mapped back to word numbers and to byte
offsets of the original text.

The windows are collected and shipped in blocks of about BLOCK_CHARS characters, names of items included, so nothing that is
broadcast grows with the benchmark: a larger benchmark takes several automata, one at a time, each run over all documents;
the driver holds one block, and the hits are united by document. Items of a window that stands in very many of them are dealt
to several entries. Documents are never shuffled for a single block.

Defined results: null or empty text has no words and is not contaminated; items without words match nothing; a null
item_id is listed as "null"; equal item_ids count once; each of several equal documents gets a row; a null doc_id
stays null; empty tables work on either side; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import bytescan, repeats
from ledgerloom.llm.scratch import materialize

SPAN = 10
BLOCK_CHARS = 2_000_000
ENTRY_ITEMS = 10_000
_WORD = [c >= 0x80 or chr(c).isalnum() for c in range(256)]
SEPARATORS = np.array([not x for x in _WORD])
TABLE = bytes(ord(chr(c).lower()) if c < 0x80 and _WORD[c] else c if _WORD[c] else 0x20 for c in range(256))
_automata: dict = {}


def normalised(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _item_windows(span: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), bytescan.column(batch, "text"), strict=True):
                words = normalised(text)
                for i in range(max(1, len(words) - span + 1) if words else 0):
                    ids.append(item)
                    windows.append(b" ".join(words[i : i + span]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary()).cast(pa.string())], ["item", "window"])

    return scan


def _automaton(windows: dict[str, list[str]], token: str):
    """Built once in a worker process; the last one is kept."""
    if token not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for window, items in windows.items():
            raw = window.encode()
            built.add_word(f" {raw.decode('latin-1')} ", (raw.count(b" ") + 1, items))
        if windows:
            built.make_automaton()
        _automata.clear()
        _automata[token] = built
    return _automata[token]


def _scanner(windows: dict[str, list[str]]):
    import uuid

    token = uuid.uuid4().hex

    def hits(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: the number of words, the hit word ranges, and the items."""
        automaton = _automaton(windows, token)
        for text in texts:
            words = normalised(text)
            found, items = [], set()
            if windows and words:
                line = b" ".join([b"", *words, b""])
                ends = None
                for end, (n, owners) in automaton.iter(line.decode("latin-1")):
                    if ends is None:
                        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
                    last = int(np.searchsorted(ends, end))
                    found.append((last - n, last))
                    items.update(owners)
            yield len(words), found, items

    return hits


def _original(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as byte ranges of the original text, overlapping ones united."""
    words = bytescan.Words([text], SEPARATORS)
    lo, hi = bytescan.merged(np.array([a for a, _ in ranges]), np.array([b for _, b in ranges]))
    return [{"start": int(words.starts[a]) - 1, "end": int(words.ends[b - 1]) - 1} for a, b in zip(lo, hi, strict=True)]


def _batch(ids: pa.Array, rows: list[tuple[int, list, set]], spans: list | None) -> pa.RecordBatch:
    n_hit = []
    for _, ranges, _ in rows:
        lo, hi = bytescan.merged(np.array([a for a, _ in ranges], np.int64), np.array([b for _, b in ranges], np.int64))
        n_hit.append(int((hi - lo).sum()))
    out = {
        "doc_id": ids,
        "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(items) for _, _, items in rows], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, _, items in rows], pa.string()),
        "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
    }
    if spans is not None:
        out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_pydict(out)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, span: int, block_chars: int) -> tuple[int, Iterator]:
    """The number of blocks, and a scanner for each; a block's windows are collected when it is asked for, and held by nothing else."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    windows = items.mapInArrow(_item_windows(span), "item string, window string")
    # Equal rows are combined first, in salted entries, so that a window of all items meets in no task.
    salt = F.pmod(F.xxhash64("item"), F.lit(64))
    held = windows.distinct().groupBy("window", salt.alias("salt")).agg(F.count("*").alias("n")).groupBy("window").agg(F.sum("n").alias("n"))
    held = materialize(held.withColumn("entries", F.ceil(F.col("n") / ENTRY_ITEMS)), "windows")
    big = held.filter("entries > 1").select("window", "entries")
    entry = F.pmod(F.xxhash64(F.lit(5), "item"), F.coalesce("entries", F.lit(1).cast("long")))
    grouped = windows.distinct().join(big.hint("merge"), "window", "left").groupBy("window", entry.alias("entry")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    chars = F.length("window") + 2 + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x) + 1)
    grouped = materialize(grouped.withColumn("chars", chars), "entries")
    blocks = max(1, -(-(grouped.agg(F.sum("chars")).first()[0] or 0) // block_chars))
    dealt = grouped.withColumn("block", F.pmod(F.xxhash64("window", "entry"), F.lit(blocks)))

    def each() -> Iterator:
        for i in range(blocks):
            found: dict[str, list[str]] = {}
            for r in dealt.filter(F.col("block") == i).collect():
                found.setdefault(r["window"], []).extend(r["items"])
            yield _scanner(found)

    return blocks, each()


def _parts(rows: DataFrame, scanners: Iterator) -> DataFrame:
    """doc, key, lo, hi and items of the documents that each block hits, written block by block."""
    parts = None
    for hits in scanners:

        def partly(batches: Iterator[pa.RecordBatch], hits=hits) -> Iterator[pa.RecordBatch]:
            for batch in bytescan.parts(batches):
                keep, lo, hi, names = [], [], [], []
                for k, (_, ranges, owners) in enumerate(hits(bytescan.column(batch, "text"))):
                    if ranges:
                        keep.append(k)
                        lo.append([a for a, _ in ranges])
                        hi.append([b for _, b in ranges])
                        names.append(sorted(owners))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64())),
                        pa.array(names, pa.list_(pa.string()))
                    ],
                    ["doc", "key", "lo", "hi", "items"]
                )

        part = materialize(rows.select("doc", "key", "text").mapInArrow(partly, "doc long, key long, lo array<long>, hi array<long>, items array<string>"), "hits")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = SPAN, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs, all columns and rows as they are, without the documents that hold a window. A single block takes no shuffle."""
    blocks, scanners = _blocks(benchmark, item_col, item_text_col, span, block_chars)
    if blocks > 1:
        doc, key = ("k" * (max(map(len, docs.columns)) + n) for n in (1, 2))  # names that no column has
        rows = repeats.keyed(docs, id_col, text_col)
        gone = _parts(rows, scanners).select(F.col("doc").alias(doc), F.col("key").alias(key)).distinct()
        marked = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NO_ID)), key: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
        return marked.join(gone.hint("merge"), [doc, key], "left_anti").drop(doc, key)
    marked, mark, added = repeats.beside_text(docs, text_col)
    hits = next(scanners)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            keep = pa.array([not ranges for _, ranges, _ in hits(bytescan.column(batch, mark))], pa.bool_())
            yield (batch.drop_columns([mark]) if added else batch).filter(keep)

    return marked.mapInArrow(judge, docs.schema)


def scan(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = SPAN, block_chars: int = BLOCK_CHARS, with_spans: bool = False
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a hit), n_items, items_sha256, contaminated and, if asked for, spans (bytes of the original)."""
    blocks, scanners = _blocks(benchmark, item_col, item_text_col, span, block_chars)
    rows = repeats.keyed(docs, id_col, text_col)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", spans array<struct<start: long, end: long>>" * with_spans

    if blocks == 1:
        hits = next(scanners)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bytescan.parts(batches):
                texts = bytescan.column(batch, "text")
                found = list(hits(texts))
                yield _batch(batch.column(0), found, [_original(t, r) if r else [] for t, (_, r, _) in zip(texts, found, strict=True)] if with_spans else None)

        return rows.select("id", "text").mapInArrow(whole, schema)

    # Equal rows have equal hits; one of them is kept for each block.
    per_key = _parts(rows, scanners).distinct().groupBy("doc", "key").agg(
        F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"), F.flatten(F.collect_list("items")).alias("items")
    )

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            texts = bytescan.column(batch, "text")
            found = [
                (
                    len(normalised(t)), list(zip(a or (), b or (), strict=True)), set(c or ())
                ) for t, a, b, c in zip(texts, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            ]
            yield _batch(batch.column(0), found, [_original(t, r) if r else [] for t, (_, r, _) in zip(texts, found, strict=True)] if with_spans else None)

    return rows.join(per_key.hint("merge"), ["doc", "key"], "left").select("id", "text", "lo", "hi", "items").mapInArrow(united, schema)
