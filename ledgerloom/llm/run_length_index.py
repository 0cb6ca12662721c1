"""Exact byte-repeat removal by a run-length index.

A byte is removed if it is covered by a string of span bytes that also starts anywhere else in the corpus, the same
document included; strings never cross documents and are judged on the input.

Which text can repeat at all is found by winnowed anchors (see repeats; nothing that repeats is lost). The regions
around repeated anchors are gathered by anchor; identical regions collapse to one with a count, since further copies
add no runs to a Burrows-Wheeler transform. Each bucket of regions is indexed by itself: the transform is stored as
runs, with the suffix positions at both ends of each run and the common prefix of the suffixes at each boundary.
From these O(runs) samples one pass over the text streams its matching statistics against all the rest, and window
starts whose statistic reaches span are marked. Equal strings always have equal anchors, so they meet in a bucket.

A bucket's size is bounded: the regions of an anchor with more than HOT_BYTES of them are cut into pieces of STEPS[0]
window starts, which are gathered and indexed by the bytes that all their windows share; pieces of which one such core
still has too many are cut again, at last to single windows, which can't be too many, as equal ones collapse. Buckets
are packed by size, to at most BUCKET_BYTES + HOT_BYTES each (and one region, of less than 2 * span bytes).

Defined results: null text is empty; empty and short texts are kept; a null id is like any other; each of several
equal rows is a text of its own, so their long strings repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm import bytescan, repeats
from ledgerloom.llm.repeats import salted_join
from ledgerloom.llm.scratch import materialize, scope

SPAN = 200
GRAM = 32
BUCKET_BYTES = 1 << 19
HOT_BYTES = 1 << 18
STEPS = (16, 4, 1)
BUCKET = pa.struct([("part", pa.int64()), ("slot", pa.int64())])


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that are still tied are sorted again, in one packed key where two ranks and a place fit into it."""
    n = len(codes)
    wide = (n + 1).bit_length()
    low = (1 << wide) - 1
    bits = max(1, int(codes.max(initial=0)).bit_length())
    depth = max(1, (63 - wide) // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(np.int64)
    for i in range(depth):
        key = (key << bits) | padded[i : i + n]
    packed = (key << wide) | np.arange(n)
    packed.sort()
    order, key = packed & low, packed >> wide
    slots = np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    idx = order
    while True:
        rank[idx] = slots[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))] + 1
        tied = ~(head & np.append(head[1:], True))
        if not tied.any():
            return order
        slots, idx = slots[tied], idx[tied]
        after = np.minimum(idx + depth, n)
        head = np.ones(len(idx), bool)
        if 3 * wide <= 63:
            packed = (rank[idx] << (2 * wide)) | (rank[after] << wide) | np.arange(len(idx))
            packed.sort()
            idx = idx[packed & low]
            key = packed >> wide
            head[1:] = key[1:] != key[:-1]
        else:
            pairs = rank[idx], rank[after]
            by = np.lexsort(pairs[::-1])
            head[1:] = np.any([x[by][1:] != x[by][:-1] for x in pairs], axis=0)
            idx = idx[by]
        order[slots] = idx
        depth *= 2


class RunLengthIndex:
    """The run-compressed transform of a text: symbols and lengths of runs, sampled ends, and prefixes at boundaries."""

    def __init__(self, codes: np.ndarray):
        self.size = n = len(codes)
        order = suffix_array(codes)
        transform = codes[order - 1].astype(np.int16)
        transform[order == 0] = -1  # nothing precedes the first suffix
        heads = np.ones(n, bool)
        heads[1:] = transform[1:] != transform[:-1]
        at = np.flatnonzero(heads)
        self.symbols, self.lengths = transform[at], np.diff(np.append(at, n))
        self.first, self.last = order[at], order[np.append(at[1:], n) - 1]
        self.shared = self._common(codes, self.last[:-1], self.first[1:])

    @staticmethod
    def _common(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b."""
        text = np.concatenate([codes.astype(np.uint64), np.zeros(16, np.uint64)])
        eight = np.zeros(len(codes) + 8, np.uint64)
        for i in range(8):
            eight |= text[i : i + len(eight)] << np.uint64(8 * i)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            differ = eight[a] ^ eight[b]
            end = differ != 0
            least = differ[end] & (~differ[end] + np.uint64(1))
            out[live[end]] += sum((least >= np.uint64(1 << (8 * i))).astype(np.int64) for i in range(1, 8))
            live, a, b = live[~end], a[~end] + 8, b[~end] + 8
            out[live] += 8
            if len(live) and max(a.max(), b.max()) >= len(eight):
                inside = (a < len(eight)) & (b < len(eight))
                live, a, b = live[inside], a[inside], b[inside]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest string from there that also starts elsewhere in the text.

        Inside a run, the neighbour of the suffix one position on is one position on too, with one symbol less in
        common; so the value at any position follows from the nearest sample before it.
        """
        best = np.zeros(self.size, np.int64)
        positions = np.arange(self.size)
        for sample, shared in ((self.first, np.append(0, self.shared)), (self.last, np.append(self.shared, 0))):
            at = np.full(self.size, -1)
            at[sample] = sample
            at = np.maximum.accumulate(at)
            value = np.zeros(self.size, np.int64)
            value[sample] = shared
            known = at >= 0
            best[known] = np.maximum(best[known], value[at[known]] - (positions[known] - at[known]))
        return best


def repeated_starts(regions: list[bytes], weights: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, lo, hi): runs of window starts in regions at which a string of span bytes starts that starts elsewhere too."""
    raw = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    begin = np.cumsum(sizes + 1) - sizes - 1
    present = np.zeros(256, bool)
    present[raw] = True
    code = np.cumsum(present).astype(np.uint8)  # from 1 on: UTF-8 never uses all 256 values, and 0 parts the regions
    codes = np.zeros(int(sizes.sum()) + len(regions), code.dtype)
    codes[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))] = code[raw]
    statistics = RunLengthIndex(codes).matching_statistics()
    counts = np.maximum(sizes - span + 1, 0)
    owner = np.repeat(np.arange(len(regions)), counts)
    marked = (statistics[bytescan.ragged(begin, counts)] >= span) | (weights[owner] > 1)
    shift = bytescan.ragged(np.zeros(len(regions), np.int64), counts)
    on = np.flatnonzero(marked)
    if not len(on):
        return on, on, on
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(on)) - 1
    return owner[on[heads]], shift[on[heads]], shift[on[tails]] + 1


def _cut_regions(span: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            out = {"anchor": [], "cover": [], "c": [], "bucket": [], "region": []}
            for text, runs in zip(bytescan.column(batch, "text"), batch.column(1).to_pylist(), strict=True):
                for run in runs:
                    for name in ("anchor", "cover", "c", "bucket"):
                        out[name].append(run[name])
                    out["region"].append(text[run["pos"] : run["pos"] + run["n"] - 1 + span])
            types = (pa.int64(), pa.int64(), pa.int64(), BUCKET, pa.binary())
            if out["anchor"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return scan


def _index_bucket(span: int):
    def index(table: pa.Table) -> pa.Table:
        regions = table.column("region").to_pylist()
        owner, lo, hi = repeated_starts(regions, table.column("c").to_numpy(), span)
        anchor, cover = table.column("anchor").to_numpy()[owner], table.column("cover").to_numpy()[owner]
        return pa.table({"anchor": anchor, "cover": cover, "from_shift": lo, "to_shift": hi})

    return index


def _split_regions(span: int, gram: int, step: int):
    """Cuts regions of one anchor (or core) into pieces of `step` window starts, at places counted from the first anchor.

    `at` is the place of a region's first byte, counted from its anchor, or null where the anchor is yet to be found. All
    windows of a piece share its core, the bytes that each of them covers. Equal windows lie at equal places from equal
    anchors, so they fall into pieces with equal cores.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches, 128):
            anchors, covers, counts = (batch.column(i).to_numpy() for i in range(3))
            out: dict[str, list] = {x: [] for x in ("core", "content", "c", "anchor", "cover", "shift", "at", "region")}
            for i, (place, region) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                raw = np.frombuffer(region, np.uint8)
                if place is None:
                    place = -int(np.flatnonzero(bytescan.of_bytes(raw).windows(gram).view(np.int64) == anchors[i])[0])
                n = len(region) - span + 1
                bounds = np.unique(np.concatenate([[0, n], np.arange(-place % step, n, step)]))
                lo, hi = bounds[:-1], bounds[1:]
                first = (place + lo) // step * step - place  # where the whole piece begins, even if its first windows are another run's
                salt = np.array([first + place, np.full(len(lo), anchors[i])]).T.astype(np.int64)
                core = bytescan.slice_hashes(raw, first + step - 1, first + span) ^ bytescan.slice_hashes(
                    salt.ravel(), np.arange(0, 2 * len(lo), 2), np.arange(2, 2 * len(lo) + 2, 2)
                )
                extent = bytescan.mix(((lo - first) * (step + 1) + hi - lo).astype(np.uint64)).view(np.int64)
                out["core"].append(core)
                out["content"].append(bytescan.slice_hashes(raw, lo, hi - 1 + span) ^ extent)
                for name, value in (("c", counts[i]), ("anchor", anchors[i]), ("cover", covers[i])):
                    out[name].append(np.full(len(lo), value))
                out["shift"].append(lo)
                out["at"].append(lo + place)
                out["region"] += [region[x : y - 1 + span] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            if out["core"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["region"], pa.binary()) if name == "region" else pa.array(np.concatenate(value)) for name, value in out.items()],
                    list(out)
                )

    return scan


def _bucketed(contents: DataFrame, size: Column, bucket_bytes: int, most: float) -> DataFrame:
    """contents (anchor, cover, ...) with bucket: anchors dealt to buckets of at most bucket_bytes and one anchor's contents.

    Anchors with more than `most` bytes get none. The others are dealt to groups of some 64 buckets by their hash, and
    filled in within each group.
    """
    held = contents.groupBy("anchor").agg(F.sum(size).alias("held"), F.count("*").alias("c"))
    held = materialize(held.withColumn("cold", F.when(F.col("held") <= most, F.col("held")).otherwise(0)), "held")
    groups = max(1, (held.agg(F.sum("cold")).first()[0] or 0) // (64 * bucket_bytes))
    upto = F.sum("cold").over(Window.partitionBy("part").orderBy("anchor").rowsBetween(Window.unboundedPreceding, 0))
    dealt = held.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups))).withColumn("slot", F.floor((upto - F.col("cold")) / bucket_bytes).cast("long"))
    dealt = materialize(dealt.select("anchor", "c", F.when(F.col("held") <= most, F.struct("part", "slot")).alias("bucket")), "buckets")
    return salted_join(contents, dealt, ["anchor"], ["cover"])


def repeated_windows(regions: DataFrame, span: int, gram: int, bucket_bytes: int, hot_bytes: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(anchor, cover, from_shift, to_shift): window starts of regions at which a string starts that starts elsewhere too.

    regions: anchor, cover, c (how many equal ones there are), bucket (null: to be cut), at (see _split_regions) and region.
    """
    names = "anchor long, cover long, from_shift long, to_shift long"
    cold = regions.filter("bucket is not null").select("bucket", "anchor", "cover", "c", "region")
    found = materialize(cold.groupBy("bucket").applyInArrow(_index_bucket(span), names), "found")
    hot = regions.filter("bucket is null").select("anchor", "cover", "c", "at", "region")
    if hot.isEmpty():
        return found
    names = "core long, content long, c long, anchor long, cover long, shift long, at long, region binary"
    pieces = materialize(hot.mapInArrow(_split_regions(span, gram, steps[0]), names), "pieces")
    distinct = pieces.groupBy(F.col("core").alias("anchor"), F.col("content").alias("cover")).agg(
        F.sum("c").alias("c"), F.count("*").alias("rows"), F.any_value(F.struct("at", "region")).alias("own")
    )
    distinct = materialize(distinct.select("anchor", "cover", F.col("c").alias("times"), "rows", "own.*"), "distinct")
    # The last step leaves one content to each core: none is cut again.
    bucketed = _bucketed(distinct, F.length("region") + 1, bucket_bytes, hot_bytes if len(steps) > 1 else float("inf"))
    bucketed = materialize(bucketed.select("anchor", "cover", F.col("times").alias("c"), "bucket", "at", "region"), "bucketed")
    finer = repeated_windows(bucketed, span, gram, bucket_bytes, hot_bytes, steps[1:]).withColumnsRenamed({"anchor": "core", "cover": "content"})
    of_piece = finer.groupBy("core", "content").agg(F.collect_list(F.struct("from_shift", "to_shift")).alias("shifts"))  # at most one for each window of a piece
    often = distinct.select(F.col("anchor").alias("core"), F.col("cover").alias("content"), F.col("rows").alias("c"))
    of_piece = materialize(of_piece.join(often.hint("merge"), ["core", "content"]), "of_piece")
    back = salted_join(pieces.drop("region", "c"), of_piece, ["core", "content"], ["anchor", "cover", "shift"]).select("anchor", "cover", "shift", F.inline("shifts"))
    back = back.select("anchor", "cover", (F.col("shift") + F.col("from_shift")).alias("from_shift"), (F.col("shift") + F.col("to_shift")).alias("to_shift"))
    return found.unionByName(materialize(back, "back"))


def removal_intervals(rows: DataFrame, span: int = SPAN, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc, key, lo, hi): half-open byte intervals that repeated strings cover; and (doc, key, c), the number of runs. rows: as from repeats.keyed()."""
    with scope(rows.sparkSession) as keep:
        runs = keep(materialize(repeats.repeated_runs(repeats.anchored_runs(rows, span, gram, by_word=False), across_docs=False), "runs"))
        covers = materialize(runs.groupBy("anchor", "cover").agg(F.count("*").alias("times"), F.min(F.struct("doc", "key", "pos", "n")).alias("own")), "covers")
        # Sizes are known from the runs, so buckets are chosen before any text moves.
        bucketed = _bucketed(covers.select("anchor", "cover", "times", "own.*"), F.col("n") + span, bucket_bytes, hot_bytes)
        per_key = bucketed.groupBy("doc", "key").agg(F.collect_list(F.struct("anchor", "cover", F.col("times").alias("c"), "bucket", "pos", "n")).alias("runs"))
        # Of rows equal in id and text one gives the regions, so that each stands there once whatever the number of rows. Such
        # rows are alike in all columns: where they are many, they are salted by the task that read them.
        sizes = keep(materialize(runs.groupBy("doc", "key").agg(F.count("*").alias("c")), "sizes"))
        texts = rows.select("doc", "key", "text", F.spark_partition_id().alias("task"))
        owners = salted_join(texts, per_key, ["doc", "key"], ["task"], counts=sizes).dropDuplicates(["doc", "key"])
        schema = "anchor long, cover long, c long, bucket struct<part: long, slot: long>, region binary"
        regions = owners.select("text", "runs").mapInArrow(_cut_regions(span), schema)
        regions = materialize(regions.withColumn("at", F.lit(None).cast("long")), "regions")
        found = repeated_windows(regions, span, gram, bucket_bytes, hot_bytes)
        of_run = found.groupBy("anchor", "cover").agg(F.collect_set(F.struct("from_shift", "to_shift")).alias("shifts"))  # at most one for each window of a run
        of_run = keep(materialize(of_run.join(covers.select("anchor", "cover", F.col("times").alias("c")).hint("merge"), ["anchor", "cover"]), "of_run"))
    back = salted_join(runs, of_run, ["anchor", "cover"], ["doc", "key", "pos"]).select("doc", "key", "pos", F.inline("shifts"))
    return back.select("doc", "key", (F.col("pos") + F.col("from_shift")).alias("lo"), (F.col("pos") + F.col("to_shift") - 1 + span).alias("hi")), sizes


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, spans (start, end in bytes)."""
    if span < 2 * STEPS[0]:
        raise ValueError(f"a string has at least {2 * STEPS[0]} bytes")
    rows = repeats.keyed(docs, id_col, text_col)
    cut = repeats.with_intervals(rows, *removal_intervals(rows, span, min(GRAM, span // 2))).select("id", "text", "cut")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            total, removed, n_spans, digests, spans = [], [], [], [], []
            for text, cut in zip(bytescan.column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                total.append(len(text))
                if not cut:
                    removed.append(0)
                    n_spans.append(0)
                    digests.append(hashlib.sha256(text).hexdigest())
                    spans.append([])
                    continue
                starts, ends = bytescan.merged(np.array([x["lo"] for x in cut]), np.array([x["hi"] for x in cut]))
                digest, at = hashlib.sha256(), 0
                for s, e in zip(starts, ends, strict=True):
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                removed.append(int((ends - starts).sum()))
                n_spans.append(len(starts))
                digests.append(digest.hexdigest())
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends, strict=True)])
            out = [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, n_spans)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_spans:
                out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return cut.mapInArrow(finish, schema + ", spans array<struct<start: long, end: long>>" * with_spans)
