"""Substring dedup by words: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word is a maximal run of bytes other than space and U+0009 to U+000D. A window is span consecutive words of
one document. A word is removed if a window that covers it also starts in a document with a smaller id.

Windows are first grouped into anchored runs (see repeats), whose hash covers all their windows at once: a run that
equals another one as a whole is settled by one count. Where two different runs share an anchor, each window's own
Rabin-Karp hash, modulo the prime 2**61 - 1, is counted under the anchor. So each window that may repeat is compared,
with far fewer rows than windows; two different windows clash with a chance of some 2**-55 each, and only under one anchor.

Defined results: null or empty text has no words (kept text is empty); a null id stands after all other ids; rows
with equal ids never remove from each other, repeated rows included; an empty table gives no rows; other columns
are not read, whatever their names. Texts shorter than the window are kept whole (white space becomes one space).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import bytescan, repeats
from ledgerloom.llm.scratch import materialize, scope

SPAN = 50
GRAM = 12


def _window_hashes(span: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            texts = bytescan.column(batch, "text")
            docs = batch.column(0).to_numpy()
            runs = batch.column(2).to_pylist()
            for low, high in bytescan.chunks(texts):
                words = bytescan.Words(texts[low:high])
                rolling = bytescan.PrimeRolling(words.hashes())
                out = [[], [], [], [], []]
                for i in range(low, high):
                    for run in runs[i]:
                        at = np.arange(run["pos"], run["pos"] + run["n"]) + words.first[i - low]
                        for values, x in zip(
                            out,
                            (
                                np.full(len(at), run["anchor"]), rolling.of(at, at + span).view(np.int64), np.full(len(at), run["cover"]),
                                np.full(len(at), docs[i]), np.arange(run["n"])
                            ),
                            strict=True
                        ):
                            values.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor", "window", "cover", "doc", "shift"])

    return scan


def removal_intervals(rows: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc, key, lo, hi): half-open word intervals that windows with an earlier copy cover. rows: as from repeats.keyed()."""
    with scope(rows.sparkSession) as keep:
        runs = repeats.repeated_runs(repeats.anchored_runs(rows, span, gram, by_word=True), across_docs=True)
        runs = keep(materialize(runs, "runs"))
        covers = runs.groupBy("anchor", "cover").agg(F.min("doc").alias("first_doc"), F.count("*").alias("c"), F.min(F.struct("doc", "key", "pos", "n")).alias("own"))
        covers = keep(materialize(covers, "covers"))
        end = F.col("pos") + F.col("n") - 1 + span
        whole = repeats.salted_join(runs, covers.select("anchor", "cover", "first_doc", "c"), ["anchor", "cover"], ["doc", "key", "pos"])
        whole = whole.filter("doc > first_doc").select("doc", "key", F.col("pos").alias("lo"), end.alias("hi"))

        several = materialize(covers.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1"), "several")
        unsettled = repeats.salted_join(covers.select("anchor", "cover", "own.*"), several, ["anchor"], ["cover"], "left_semi")
        per_key = materialize(unsettled, "unsettled").groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "cover", "pos", "n")).alias("runs"))
        # Equal rows share a key and give equal windows, which the counts below don't mind.
        texts = rows.select("doc", "key", "text").join(per_key, ["doc", "key"]).select("doc", "text", "runs")
        windows = materialize(texts.mapInArrow(_window_hashes(span), "anchor long, window long, cover long, doc long, shift long"), "windows")
        firsts = windows.groupBy("anchor", "window").agg(F.min("doc").alias("lo_doc"), F.max("doc").alias("hi_doc"), F.count("*").alias("c")).filter("lo_doc < hi_doc")
        firsts = materialize(firsts.select("anchor", "window", "lo_doc", "c"), "firsts")
        later = repeats.salted_join(windows, firsts, ["anchor", "window"], ["cover", "doc", "shift"]).filter("doc > lo_doc").select("anchor", "cover", "doc", "shift").distinct()
        later = keep(materialize(later, "later"))
    # Holds for each run with this content in this document; runs of it in later documents are removed as a whole.
    single = runs.join(later, ["anchor", "cover", "doc"]).select("doc", "key", (F.col("pos") + F.col("shift")).alias("lo"), (F.col("pos") + F.col("shift") + span).alias("hi"))
    return whole.unionByName(single)


def _removed(cut: list | None, n: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    for x in cut or ():
        delta[x["lo"]] += 1
        delta[x["hi"]] -= 1
    return np.cumsum(delta[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for, kept_text."""
    if span < 2:
        raise ValueError("a window has at least two words")
    rows = repeats.keyed(docs, id_col, text_col)
    cut = repeats.with_intervals(rows, removal_intervals(rows, span, min(GRAM, span - 1))).select("id", "text", "cut")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            ids, texts, cuts = batch.column(0), bytescan.column(batch, "text"), batch.column(2).to_pylist()
            total, removed, digests, kept_texts = [], [], [], []
            for text, cut in zip(texts, cuts, strict=True):
                words = text.split()
                total.append(len(words))
                if cut:
                    gone = _removed(cut, len(words))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                removed.append(total[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode("utf-8", "replace"))
            out = [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names)

    return cut.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
