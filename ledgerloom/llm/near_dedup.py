"""Near-duplicate classes by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles.

Words are lower-cased (A-Z) runs of letters and digits; shingles are five consecutive words (all words, if fewer). A
shingle weighs tf * (1 + DAMPING * idf). idf = ln(n / df) / ln(RARE), held to 0..1: 0 for shingles of every document, 1 for all that
at most one document in RARE has. So weights depend on shares of the corpus and not on its size. The damping is
deliberate: a large group of copies raises the document frequency of its own shingles, and undamped weights would then
push its similarity below the threshold.

Document frequencies come from all documents. They are kept in BUCKETS hashed counters, so the table has a fixed
size and can be broadcast. What unrelated rare shingles add to every counter, the median, is taken off; what remains of
them is far below n / RARE, the least frequency that matters to the weights, at every size of the corpus.

Each text gets BANDS * ROWS consistent samples. Texts that agree on a band are candidates. Exact copies collapse
first. A bucket of at most SMALL texts is compared in all pairs; in a larger one all texts are compared with the text
that shares most buckets with others, which the source of a group of edited copies does. Compared texts are linked if
their weighted Jaccard similarity is at least the threshold, and classes are connected components. Pairs within a class need no comparison.
All other pairs of texts in large buckets that still hold several classes are found by an exact similarity join
(`_prefixes`), which leaves out only pairs that cannot reach the threshold, and are compared until each pair is of one
class or has failed. No task holds a group, and hot buckets and leaders are salted; but texts that are nearly at
the threshold to many of other classes cost a comparison for each pair.

Defined results: texts without words are copies of each other if equal, and of nothing else; null text is empty; a
class is named by its least doc_id; a null doc_id is greater than all others (its class, if alone, has a null name);
rows with equal ids and different texts are different documents; an empty table gives no rows; other columns are
neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm import bytescan, repeats
from ledgerloom.llm.components import components
from ledgerloom.llm.decontaminate import SEPARATORS, TABLE
from ledgerloom.llm.repeats import salted_join
from ledgerloom.llm.scratch import materialize, scope

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
SLICES = 1024
DAMPING = 0.5
RARE = 1024
SMALL = 8
FIRST = 4  # candidates of a text that are compared in the first round over the large buckets
PAIRS_A_TASK = 4000
SLACK = 1e-6  # for rounding
SIZE_STEPS = 4  # of a text's total weight, from one to the least that may be its partner
_DOC_BITS = 16
_SHINGLE = np.uint64((1 << 48) - 1)
_random = np.random.default_rng(77)
_SALTS = _random.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_RATE = _random.gamma(2.0, 1.0, 1 << 12)
_PER_RATE = 1 / _RATE
_LOG_SCALE = np.log(_random.gamma(2.0, 1.0, 1 << 16))


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, tf), sorted by owner and shingle: the distinct 48-bit shingle hashes of each text. At most 2**16 texts."""
    words = bytescan.Words(texts, SEPARATORS, TABLE)
    rolling = bytescan.Rolling(words.hashes())
    has = np.flatnonzero(words.count)
    counts = np.maximum(words.count[has] - width + 1, 1)
    at = bytescan.ragged(words.first[has], counts)
    owner = np.repeat(has, counts)
    end = np.minimum(at + width, np.repeat(words.first[has] + words.count[has], counts))
    packed = (rolling.of(at, end) & _SHINGLE) | (owner.astype(np.uint64) << np.uint64(48))
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    first = np.flatnonzero(new)
    return (packed[first] >> np.uint64(48)).astype(np.int64), packed[first] & _SHINGLE, np.diff(np.append(first, len(packed)))


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for low, high in bytescan.chunks(texts):
        for at in range(low, high, 1 << _DOC_BITS):
            yield at, min(high, at + (1 << _DOC_BITS))


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (bytescan.mix(shingle) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_frequencies(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(BUCKETS, np.uint32), [], 0
        for batch in bytescan.parts(batches):
            texts = bytescan.column(batch, "text")
            for low, high in _pieces(texts):
                waiting.append(_bucket(shingles(texts[low:high], width)[1]))
                n += len(waiting[-1])
                if n > BUCKETS:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS).astype(np.uint32)
                    waiting, n = [], 0
        if n:
            total += np.bincount(np.concatenate(waiting), minlength=BUCKETS).astype(np.uint32)
        slices = total.reshape(SLICES, -1)
        held = np.flatnonzero(slices.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([slices[i].tobytes() for i in held], pa.binary())], ["slice", "counts"])

    return count


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices as they stream in: at most SLICES short arrays are held, however many parts the corpus has."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i not in total:
                total[i] = np.zeros(BUCKETS // SLICES, np.int64)
            total[i] += np.frombuffer(value.as_buffer(), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def frequencies(rows: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The number of documents with a shingle in each counter: BUCKETS numbers, whatever the corpus."""
    counts = rows.select("text").mapInArrow(_count_frequencies(width), "slice long, counts binary")
    df = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in counts.repartition("slice").mapInArrow(_add, "slice long, counts binary").collect():
        df[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return df.ravel()


def weight_table(rows: DataFrame, width: int = WIDTH, damping: float = DAMPING) -> np.ndarray:
    """The factor 1 + damping * idf of each counter."""
    return factors(frequencies(rows, width), rows.count(), damping)


def factors(df: np.ndarray, n: int, damping: float = DAMPING) -> np.ndarray:
    own = np.clip(df - np.median(df), 1, max(1, n))
    idf = np.log(max(1, n) / own) / np.log(RARE)
    return (1 + damping * np.clip(idf, 0, 1)).astype(np.float32)


def samples(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n rows of BANDS * ROWS consistent samples. owner: ascending, each of 0..n-1 at least once."""
    log_weight = np.log(weight)
    begin = np.searchsorted(owner, np.arange(n))
    sizes = np.diff(np.append(begin, len(owner)))
    out = np.empty((n, BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        h = bytescan.mix(shingle ^ _SALTS[k])
        rate_at = (h & np.uint64(0xFFF)).astype(np.int64)
        beta = ((h >> np.uint64(28)) & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        level = np.floor(log_weight * _PER_RATE[rate_at] + beta)
        cost = _LOG_SCALE[((h >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.int64)] - _RATE[rate_at] * (level + 1 - beta)
        least = np.minimum.reduceat(cost, begin)
        at = np.flatnonzero(cost == np.repeat(least, sizes))
        at = at[np.searchsorted(at, begin)]
        out[:, k] = shingle[at] ^ bytescan.mix(level[at].astype(np.int64).astype(np.uint64) + _SALTS[k])
    return out


def _sign(weights: np.ndarray, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            texts = bytescan.column(batch, "text")
            for low, high in _pieces(texts):
                owner, shingle, tf = shingles(texts[low:high], width)
                has, dense = np.unique(owner, return_inverse=True)
                bands = np.zeros((len(has), BANDS), np.uint64)
                if len(has):
                    drawn = samples(dense, shingle, tf * weights[_bucket(shingle)], len(has))
                    for b in range(BANDS):
                        value = np.full(len(has), b + 1, np.uint64)
                        for r in range(ROWS):
                            value = bytescan.mix(value ^ bytescan.mix(drawn[:, b * ROWS + r] + np.uint64(r)))
                        bands[:, b] = value
                lists: list = [None] * (high - low)
                for i, x in zip(has, bands.view(np.int64), strict=True):
                    lists[i] = x
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[low:high] for i in range(3)), pa.array(lists, pa.list_(pa.int64()))], ["doc", "h", "h2", "bands"])

    return sign


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][left], b[1][right]
    least, total = np.minimum(x, y).sum(), a[1].sum() + b[1].sum()
    return float(least / (total - least)) if total else 0.0


def _verify(weights: np.ndarray, width: int, threshold: float):
    def split(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for low, high in _pieces(texts):
            owner, shingle, tf = shingles(texts[low:high], width)
            weight = (tf * weights[_bucket(shingle)]).astype(np.float64)
            edges = np.searchsorted(owner, np.arange(high - low + 1))
            out += [(shingle[s:e], weight[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                left, right = split(bytescan.column(part, "text_u")), split(bytescan.column(part, "text_v"))
                keep = pa.array([similarity(a, b) >= threshold for a, b in zip(left, right, strict=True)], pa.bool_())
                yield part.select(["u", "v"]).filter(keep)

    return verify


def _prefixes(weights: np.ndarray, df: np.ndarray, width: int, threshold: float):
    """The shingles by which a text can meet another of the threshold or more, with the weight of the text and the rest from there.

    Shingles are in one order for all texts, rare ones (by df, counted over these texts) first. The weight that two texts
    share lies at and after their first common shingle, and reaches threshold * the weight of either, so this shingle has
    a rest of so much in both. Shingles whose counter is 1 are in no other text.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            texts = bytescan.column(batch, "text")
            for low, high in _pieces(texts):
                owner, shingle, tf = shingles(texts[low:high], width)
                if not len(owner):
                    continue
                counter = _bucket(shingle)
                order = np.lexsort((shingle, df[counter], owner))
                shingle, counter, weight = shingle[order], counter[order], (tf * weights[counter])[order].astype(np.float64)
                begin = np.searchsorted(owner, np.arange(high - low))
                sizes = np.diff(np.append(begin, len(owner)))
                total = np.bincount(owner, weight, high - low)
                before = np.append(0.0, np.cumsum(weight))
                rest = np.repeat(total + before[begin], sizes) - before[:-1]
                at = np.flatnonzero((rest >= threshold * total[owner] * (1 - SLACK)) & (df[counter] > 1))
                of = pa.array(owner[at] + low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle[at].view(np.int64)), batch.column("node").take(of), batch.column("label").take(of), pa.array(total[owner[at]]), pa.array(rest[at])],
                    ["shingle", "node", "label", "total", "rest"]
                )

    return prefixes


NODE = "struct<doc: long, h: long>"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """One row a document: id, h (its text's hash), label (the (doc, h) of the text that names its class)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NO_ID)).alias("doc"), F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit(9), text).alias("h2"), text.alias("text")
    )
    with scope(docs.sparkSession) as keep:
        weights = weight_table(rows, width)
        signed = keep(materialize(rows.mapInArrow(_sign(weights, width), "doc long, h long, h2 long, bands array<long>"), "signed"))
        # The tables joined below grow with the corpus: the hints keep them from being broadcast while they are small.
        # Exact copies: one node for each text, named by its least id.
        texts = signed.groupBy("h", "h2").agg(F.min("doc").alias("doc"), F.any_value("bands").alias("bands"))
        texts = materialize(texts.select("h", "h2", F.struct("doc", "h").alias("node"), "bands"), "texts")

        banded = texts.select("node", F.explode("bands").alias("band"))
        sizes = materialize(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        of_band = sizes.withColumn("c", F.col("size"))
        members = materialize(salted_join(banded, of_band, ["band"], ["node"]), "members")
        shared = materialize(members.groupBy("node").agg(F.sum("size").alias("shared")), "shared")
        members = materialize(members.join(shared.hint("merge"), "node"), "members")
        needed = shared.select("node", F.col("node.doc").alias("doc"), F.col("node.h").alias("h"))
        # Several rows may hold the same id and text.
        held = materialize(rows.select("doc", "h", "text").join(needed.hint("merge"), ["doc", "h"]).groupBy("node").agg(F.max("text").alias("text")), "held")

        def verified(pairs: DataFrame) -> DataFrame:
            pairs = materialize(pairs.distinct(), "pairs")
            both, n = pairs, pairs.count()
            for x, other in ("uv", "vu"):  # a leader stands in very many pairs
                often = materialize(pairs.groupBy(x).agg(F.count("*").alias("c")), "often", n)
                both = salted_join(both, held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), [x], [other], counts=often)
            linked = both.select("u", "v", "text_u", "text_v").mapInArrow(_verify(weights, width, threshold), f"u {NODE}, v {NODE}")
            return materialize(linked, "links", n, PAIRS_A_TASK)

        def named_by(links: DataFrame) -> DataFrame:
            return materialize(components(links), "labels", 2 * links.count())

        few = members.filter(F.col("size") <= small).select("band", "node")
        pairs = few.select("band", F.col("node").alias("u")).join(few.select("band", F.col("node").alias("v")), "band").filter(F.col("u") < F.col("v")).select("u", "v")
        many = materialize(
            members.filter(F.col("size") > small).select("band", "node", F.struct("shared", (-F.col("node.doc")).alias("d"), (-F.col("node.h")).alias("h")).alias("rank")),
            "many"
        )
        n_many = many.count()
        lead = materialize(many.groupBy("band").agg(F.max_by("node", "rank").alias("v")), "lead", n_many)
        star = salted_join(many, lead, ["band"], ["node"], counts=of_band).filter(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v")
        links = verified(pairs.unionByName(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))))
        label = named_by(links)
        # Large buckets that still hold several classes: all pairs of their texts that can reach the threshold.
        named = materialize(many.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "named", n_many)
        open_bands = named.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c")).filter(F.col("a") != F.col("b"))
        open_bands = materialize(open_bands.select("band", "c"), "open_bands", n_many)
        open_nodes = materialize(salted_join(named, open_bands, ["band"], ["node"], "left_semi").select("node", "label").distinct(), "open", n_many)
        if not open_nodes.isEmpty():
            open_texts = materialize(held.join(open_nodes.hint("merge"), "node").select("node", "label", "text"), "open_texts")
            prefixes = open_texts.mapInArrow(
                _prefixes(weights, frequencies(open_texts, width), width, threshold),
                f"shingle long, node {NODE}, label {NODE}, total double, rest double"
            )
            prefixes = materialize(_reaching(materialize(prefixes, "prefixes"), threshold), "reaching")
            a, b = (prefixes.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "total", "rest"))) for x in "ab")
            reaches = F.least("rest_a", "rest_b") * (1 + threshold) >= (F.col("total_a") + F.col("total_b")) * (threshold * (1 - SLACK))
            # A plain join of two written tables, of which adaptive execution splits a hot shingle's side.
            met = a.join(b.hint("merge"), "shingle").filter((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & reaches)
            met = materialize(met.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct(), "met")
            n_met = met.count()
            # Each text first meets those of its candidates that have most candidates. What is of one class by then is done.
            degree = materialize(met.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "degree", 2 * n_met)
            by = [degree.select(F.col("node").alias(x), F.struct("n", "node").alias(f"rank_{x}")).hint("merge") for x in "uv"]
            met = met.join(by[0], "u").join(by[1], "v").select(F.least("rank_u", "rank_v").alias("low"), F.greatest("rank_u", "rank_v").alias("high"))
            met = met.select(F.col("low.node").alias("u"), F.col("high.node").alias("v"), F.col("high").alias("rank"))
            take = FIRST
            while True:
                of_u, of_v = (label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")).hint("merge") for x in "uv")
                apart = met.join(of_u, "u", "left").join(of_v, "v", "left").filter(F.coalesce("label_u", "u") != F.coalesce("label_v", "v"))
                apart = materialize(apart.select("u", "v", "rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("rank"))).alias("turn")), "apart", n_met)
                if apart.isEmpty():
                    break
                found = verified(apart.filter(F.col("turn") <= take).select("u", "v"))
                met = apart.filter(F.col("turn") > take).select("u", "v", "rank")
                take *= 4
                if not found.isEmpty():
                    links = links.unionByName(found)
                    label = named_by(links)
        of_text = keep(materialize(texts.join(label.hint("merge"), "node", "left").select("h", "h2", F.coalesce("label", "node").alias("label")), "of_text"))
    return signed.select("doc", "h", "h2").join(of_text.hint("merge"), ["h", "h2"]).select("doc", "h", "label")


def _reaching(prefixes: DataFrame, threshold: float) -> DataFrame:
    """The prefix rows that can reach the threshold with the least total weight that any partner has under their shingle.

    A pair must reach it with both rests, so a row that can't reach it with the least partner is in no pair: none is lost.
    Partners' totals lie within the threshold of each other; the least is sought among those alone, by steps of the total's
    logarithm. So pages of one template, alike in size, meet no longer under the template's shingles at their prefixes' ends.
    """
    step = -math.log(threshold) / SIZE_STEPS
    sized = prefixes.withColumn("size", F.floor(F.log("total") / step))
    found = sized.groupBy("shingle", "size").agg(F.min("total").alias("least"), F.count("*").alias("n"))
    # A shingle has a row for each size here, a few hundred at most: what lies near each is looked at in place and makes no rows.
    near = Window.partitionBy("shingle").orderBy("size").rangeBetween(-SIZE_STEPS - 1, SIZE_STEPS + 1)
    least = found.select("shingle", "size", F.min("least").over(near).alias("least"), F.sum("n").over(near).alias("n")).filter("n > 1").drop("n")
    can = F.col("rest") * (1 + threshold) >= (F.col("total") + F.col("least")) * (threshold * (1 - SLACK))
    return sized.join(least.hint("merge"), ["shingle", "size"]).filter(can).select(*prefixes.columns)


def _id(column: str) -> F.Column:
    return F.when(F.col(column) != repeats.NO_ID, F.col(column))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept (it names its class)."""
    found = classes(docs, id_col, text_col, threshold)
    return found.select(
        _id("doc").alias("doc_id"), F.col("label.doc").alias("c"), (F.struct("doc", "h") == F.col("label")).alias("kept")
    ).select("doc_id", _id("c").alias("class_id"), "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all columns, without the documents that don't name their class; of rows equal in id and text one stays."""
    doc, h = ("k" * (max(map(len, docs.columns)) + n) for n in (1, 2))  # names that no column has
    kept = classes(docs, id_col, text_col, threshold).filter(F.struct("doc", "h") == F.col("label")).select(F.col("doc").alias(doc), F.col("h").alias(h)).distinct()
    kept = materialize(kept, "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NO_ID)), h: F.xxhash64(text)})
    return marked.join(kept.hint("merge"), [doc, h], "left_semi").dropDuplicates([doc, h]).drop(doc, h)
