"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z) runs of letters and digits. A document's features are the distinct hashes, to 2**BITS
places, of its words, of pairs of neighbours, and of pairs with one word between them. Training follows the
per-coordinate FTRL-proximal rule (McMahan et al., 2013): each coordinate has its own rate, and L1 keeps all but
telling coordinates at exactly zero, so that the model is a short sorted list of places and weights. Its size is
bounded by 2**BITS entries whatever the corpus; in practice it has a few thousand.

The model is fitted on a bounded sample: the TRAIN_ROWS labelled rows with the least hash of doc_id, among those that
are not held out (crc32 of doc_id as text, modulo 4, is not 2). Scoring reads every whole text and nothing else.

Defined results: null and empty texts are scored by the bias alone; labels that are null, or whose document is
missing, are left out; a document with several labels counts as toxic if any is 1; of several texts with one id the one
with the least features is the example; without any usable label the score
is 0; a null doc_id is never held out, and its labels are not used; repeated rows are scored alike; empty tables
give no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import bytescan, repeats
from ledgerloom.llm.decontaminate import SEPARATORS, TABLE

BITS = 20
TRAIN_ROWS = 8000
EPOCHS = 5
L1_SCALE = 0.25
THRESHOLD = 0.3
HOLD_OUT = 2
FOLDS = 4
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): the feature places of each text, with repeats."""
    words = bytescan.Words(texts, SEPARATORS, TABLE)
    h = words.hashes()
    owner = np.repeat(np.arange(len(texts)), words.count)
    owners, found = [owner], [h]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            owners.append(owner[gap:][same])
            found.append(bytescan.mix(h[:-gap][same] * salt + h[gap:][same]))
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_places(texts: list[bytes]) -> list[np.ndarray]:
    owner, place = places(texts)
    both = np.unique((owner << BITS) | place)
    return np.split(both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(1, len(texts))))


@dataclass
class Model:
    place: np.ndarray
    weight: np.ndarray
    bias: float
    _dense: np.ndarray | None = None

    def dense(self) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.place] = self.weight
        return self._dense

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}  # only the short list travels

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities. Only places with a weight are looked at once they are found."""
        if not len(self.place) and self.bias == -np.inf:
            return np.zeros(len(texts))
        total = np.full(len(texts), self.bias)
        dense = self.dense()
        for low, high in bytescan.chunks(texts):
            owner, place = places(texts[low:high])
            on = dense[place] != 0
            both = np.unique((owner[on] << BITS) | place[on])
            total[low:high] += np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], high - low)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(features: list[np.ndarray], labels: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal, one example at a time, in the order given; the bias is not penalised.

    l1 is by default L1_SCALE times the root of the number of examples, as the noise in a coordinate's sum grows.
    """
    l1 = L1_SCALE * len(features) ** 0.5 if l1 is None else l1
    if not len(features):
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    penalty = np.full((1 << BITS) + 1, l1)
    penalty[-1] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        value = z[at]
        short = np.sign(value) * penalty[at] - value
        return np.where(np.abs(value) <= penalty[at], 0, short / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for x, label in zip(features, labels, strict=True):
            at = np.append(x, 1 << BITS).astype(np.int64)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            squares = n[at]
            z[at] += g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / alpha * w
            n[at] = squares + g * g
    w = weights(np.arange((1 << BITS) + 1))
    place = np.flatnonzero(w[:-1])
    return Model(place, w[place], float(w[-1]))


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HOLD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Collects the features of at most `rows` labelled documents, and fits the model on the driver."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(~held_out("id"))
    sample = usable.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            found = bytescan.column(batch, "text")
            for low, high in bytescan.chunks(found):
                packed = [x.astype("<u4").tobytes() for x in distinct_places(found[low:high])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], pa.array(packed, pa.binary())], ["id", "label", "places"])

    # The sample has a bounded number of rows, so it may be broadcast.
    got = texts.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(extract, "id long, label int, places binary")
    # One example an id, so that no id brings more than its share; the order depends on ids and contents alone, so that reruns agree.
    got = got.groupBy("id", "label").agg(F.min("places").alias("places"))
    found = sorted((r["id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["id"], bytes(r["places"]), r["label"]) for r in got.collect())
    return fit([np.frombuffer(x, "<u4") for _, _, x, _ in found], np.array([float(y > 0) for *_, y in found]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' id and text with held_out, score and predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            value = model.score(bytescan.column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns and rows as they are, without the documents that score threshold or more."""
    marked, mark, added = repeats.beside_text(docs, text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.parts(batches):
            keep = model.score(bytescan.column(batch, mark)) < threshold
            yield (batch.drop_columns([mark]) if added else batch).filter(pa.array(keep))

    return marked.mapInArrow(judge, docs.schema)
