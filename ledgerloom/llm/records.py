"""Token-id output as length-delimited binary records with masked checksums, and a separate offset index.

A shard is a sequence of records, ascending by document id over all shards in the order of their names. A record is

    uint64 length | uint32 masked(crc32(length bytes)) | payload | uint32 masked(crc32(payload)) | 0x0A

little-endian throughout; length counts the payload's bytes. masked(c) is the rotation of c right by 15 bits plus
0xA282EAD8. The payload is int64 document id, uint8 flags (bit 0: the id is null; bit 1: ids are uint32, else uint16),
then the ids. The last byte lets Spark's own text writer make the shards: its commit protocol keeps each task's file
whole when executors are lost or tasks run twice, on any file system.

The index has a row a document: shard, offset, length, tokens, and the number of tokens before it in its shard. With it
a reader can visit records in any order (see shuffled_order and read_record).

Texts are dealt to shards by ranges of id, hash of the content and a random salt, cut where the bytes of the texts fill a
shard: the bounds come from a sample of rows drawn in proportion to their bytes, PER_SHARD for each shard and so a fixed
share of the shards' number, so that neither a hot id nor a stretch of long texts makes a large shard. A shard must stay below
2 GB, Spark's bound on a binary file, which with SHARD_BYTES a single text can reach but no group of texts. At 100 TB
choose shards of 512 MB. Raw bytes go through Spark's text writer as strings, which Spark 4.1 neither validates nor
changes; each shard is read back and its checksums are verified before the index is written, so another behaviour
raises an error.

Text is tokenized in pieces that the tokenizer's pattern never joins (a single space between two characters that are not
white space starts a new piece); a bounded cache keeps the ids of pieces that were seen before. A piece is known by
its bytes and length, up to 16, and by 128 bits of xxh3 and its length beyond.

Defined results: null and empty texts have the end id only; a null document id comes last; repeated rows are repeated
records; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm import bytescan, repeats, scratch

END_ID = 2
SHARD_BYTES = 32 << 20
PER_SHARD = 64
ROW_BYTES = 32  # what a record has besides its ids
LONG_PIECE = 64
CACHE_SLOTS = 1 << 21
CACHE_PIECES = 1 << 20
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<qB")

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_NEXT = _GRAPHIC.copy()  # first bytes of characters that are surely no white space
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE4:0xEE] = True
_NEXT |= _LEAD2 | _LEAD3
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = _ID.pack(doc_id or 0, (doc_id is None) | (2 if ids.dtype.itemsize == 4 else 0)) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload))), b"\n"))


def read_record(data: bytes | memoryview, offset: int) -> tuple[int | None, np.ndarray, int]:
    """The document id, its token ids, and the next record's offset. Raises if a checksum fails."""
    size, check = _HEAD.unpack_from(data, offset)
    if masked(zlib.crc32(data[offset : offset + 8])) != check:
        raise ValueError(f"the length at {offset} is damaged")
    begin, end = offset + _HEAD.size, offset + _HEAD.size + size
    payload = memoryview(data)[begin:end]
    if masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"the record at {offset} is damaged")
    doc_id, flags = _ID.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload[_ID.size :], "<u4" if flags & 2 else "<u2"), end + 5


class PieceTokenizer:
    """Token ids of texts through a tokenizer of the tokenizers library, with a bounded cache of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character a byte
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.clear()

    def clear(self) -> None:
        """Entry 0 matches nothing. Each slot names one entry; a later piece may take a slot over."""
        self.slots = np.zeros(CACHE_SLOTS, np.int32)
        self.key, self.key2 = (np.zeros(1 << 16, np.uint64) for _ in range(2))
        self.begin, self.size, self.bytes = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.bytes[0] = -1
        self.flat = np.zeros(1 << 18, self.kind)
        self.used, self.known = 0, 1

    def _ids(self, pieces: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has.

        Pieces that begin and end at cuts are encoded as one text, whose ids are parted by their lengths in bytes: no
        id crosses a cut.
        """
        counts, parts = np.zeros(len(pieces), np.int64), []
        alone = np.flatnonzero(~joinable)
        order = np.concatenate([np.flatnonzero(joinable), alone])
        if len(alone) < len(pieces):
            whole = [pieces[i] for i in order[: len(pieces) - len(alone)]]
            ids = np.array(self.tokenizer.encode(b"".join(whole).decode(), add_special_tokens=False).ids, np.int64)
            ends = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
            upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            counts[order[: len(whole)]] = np.diff(upto, prepend=0)
            parts.append(ids.astype(self.kind))
        if len(alone):
            encoded = [e.ids for e in self.tokenizer.encode_batch([pieces[i].decode() for i in alone], add_special_tokens=False)]
            counts[alone] = [len(x) for x in encoded]
            parts += [np.array(x, self.kind) for x in encoded]
        flat = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[bytescan.ragged(begin, counts)], counts

    def _store(self, keys: np.ndarray, keys2: np.ndarray, lengths: np.ndarray, pieces: list[bytes], joinable: np.ndarray) -> np.ndarray:
        """Encodes pieces and returns their places in the cache; other pieces' entries may be overwritten, never misread."""
        ids, sizes = self._ids(pieces, joinable)
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(pieces) > len(self.begin):
            self.key, self.key2, self.begin, self.size, self.bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.key2, self.begin, self.size, self.bytes))
        self.flat[self.used : self.used + total] = ids
        at = np.arange(self.known, self.known + len(pieces))
        self.begin[at] = self.used + np.cumsum(sizes) - sizes
        self.key[at], self.key2[at], self.size[at], self.bytes[at] = keys, keys2, sizes, lengths
        cached = lengths <= LONG_PIECE
        self.slots[_slot(keys, keys2, lengths)[cached]] = at[cached]
        self.used += total
        self.known += len(pieces)
        return at

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for low, high in bytescan.chunks(texts):
            out += self._chunk(texts[low:high])
        return out

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.known > CACHE_PIECES:
            self.clear()
        joined = b"".join(texts)
        if len(joined) > 8 * bytescan.CHUNK:  # a single long text: without arrays of eight bytes a byte
            return [np.array(self.tokenizer.encode(joined.decode(), add_special_tokens=False).ids, self.kind)]
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.cumsum(sizes) - sizes
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 4:
            follows, before = _FOLLOWS[data], data[2:-1]
            end = _GRAPHIC[before] | (follows[2:-1] & _LEAD2[data[1:-2]]) | (follows[2:-1] & follows[1:-2] & _LEAD3[data[:-3]])
            cut[3:-2] = ((data[3:] == 0x20) & end)[:-1] & _NEXT[data[4:]]
        inner = cut.copy()
        inner[offsets] = False  # a text's own ends are no cuts of the pattern's
        cut[offsets[sizes > 0]] = True
        starts = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        lengths = ends - starts
        keys, keys2 = bytescan.slice_keys(data, starts, ends)
        at = self.slots[_slot(keys, keys2, lengths)]
        miss = np.flatnonzero((self.key[at] != keys) | (self.key2[at] != keys2) | (self.bytes[at] != lengths))
        if len(miss):
            order = miss[np.lexsort((lengths[miss], keys2[miss], keys[miss]))]
            differs = np.ones(len(order), bool)
            differs[1:] = (keys[order[1:]] != keys[order[:-1]]) | (keys2[order[1:]] != keys2[order[:-1]]) | (lengths[order[1:]] != lengths[order[:-1]])
            new = order[differs]
            pieces = [joined[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            at[order] = self._store(keys[new], keys2[new], lengths[new], pieces, inner[starts[new]] & inner[ends[new]])[np.cumsum(differs) - 1]
        counts = self.size[at].astype(np.int64)
        ids = self.flat[bytescan.ragged(self.begin[at].astype(np.int64), counts)]
        piece = np.searchsorted(starts, offsets)
        edges = np.concatenate([[0], np.cumsum(counts)])
        begin, end = edges[piece], edges[np.append(piece[1:], len(starts))]
        return [ids[b:e] if n else ids[:0] for b, e, n in zip(begin, end, sizes, strict=True)]


def _slot(keys: np.ndarray, keys2: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (bytescan.mix(keys ^ bytescan.mix(keys2 + lengths.astype(np.uint64))) & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer_of(path: str) -> PieceTokenizer:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def shard_bounds(rows: DataFrame, shards: int, total: int) -> list[tuple[int, int, int]]:
    """Where shards begin, but for the first: (doc, key, salt), so that the texts' bytes between two bounds fill a shard.

    The sample holds PER_SHARD rows a shard; a row of many bytes stands in it several times. It is sorted and summed up in
    Spark, range by range, and only the bounds come to the driver: a row a shard.
    """
    if shards < 2:
        return []
    step = max(1, total // (shards * PER_SHARD))
    size = F.octet_length("text") + ROW_BYTES
    drawn = F.floor(size / step) + (F.rand(11) < (size % step) / step).cast("long")
    sample = rows.select("doc", "key", F.floor(F.rand(12) * (1 << 30)).cast("long").alias("salt"), drawn.alias("times")).filter("times > 0")
    with scratch.scope(rows.sparkSession):
        drawn = scratch.materialize(sample, "drawn")  # drawn once: the ranges are cut from a sample of these rows
        ranged = drawn.repartitionByRange("doc", "key", "salt").withColumn("part", F.spark_partition_id())
        ranged = scratch.materialize(ranged, "ranged")
        held = ranged.groupBy("part").agg(F.sum("times").alias("held"))
        offsets = held.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))  # a row a range
        whole = held.agg(F.sum("held")).first()[0] or 0
        within = F.sum("times").over(Window.partitionBy("part").orderBy("doc", "key", "salt").rowsBetween(Window.unboundedPreceding, 0))
        upto = ranged.withColumn("within", within).join(offsets, "part").select("doc", "key", "salt", "times", (F.col("within") + F.col("before")).alias("upto"))
        shard_of = lambda value: F.floor(value * F.lit(shards) / F.lit(max(1, whole))).cast("long")
        begins = F.least(shard_of(F.col("upto")), F.lit(shards - 1)) > shard_of(F.col("upto") - F.col("times"))
        return sorted({tuple(r) for r in upto.filter(begins).select("doc", "key", "salt").collect()})


def dealt(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """rows, each partition holding the texts of one shard in order."""
    bounds = shard_bounds(rows, shards, total)
    if not bounds:
        return rows.coalesce(1).sortWithinPartitions("doc", "key")
    names = {n: np.array([b[i] for b in bounds], np.int64) for i, n in enumerate(("doc", "key", "salt"))}
    packed = np.rec.fromarrays(list(names.values()), names="doc,key,salt")

    @F.pandas_udf("int")
    def shard_of(doc: pd.Series, key: pd.Series, salt: pd.Series) -> pd.Series:
        at = np.rec.fromarrays([doc.to_numpy(np.int64), key.to_numpy(np.int64), salt.to_numpy(np.int64)], names="doc,key,salt")
        return pd.Series(np.searchsorted(packed, at, side="right").astype(np.int32))

    salted = rows.withColumn("salt", F.floor(F.rand(13) * (1 << 30)).cast("long")).withColumn("shard", shard_of("doc", "key", "salt"))
    return salted.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc", "key")


def write(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards to folder/shards and their index to folder/index; returns the index, made by reading the shards back."""
    spark = docs.sparkSession
    rows = repeats.keyed(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        end = np.array([end_id], tokenizer.kind)
        for batch in bytescan.parts(batches):
            encoded = tokenizer.encode(bytescan.column(batch, "text"))
            framed = [frame(i, np.concatenate([x, end]))[:-1] for i, x in zip(batch.column(0).to_pylist(), encoded, strict=True)]
            values = pa.array(framed, pa.binary())
            # Raw bytes under the name of a string: Spark's text writer copies them as they are and adds the last byte.
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(values), values.buffers())], ["value"])

    in_order = dealt(rows, shards, total).select("id", "text")
    in_order.mapInArrow(encode, "value string").write.option("lineSep", "\n").option("compression", "none").text(f"{folder}/shards")
    read_index(spark, folder).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Scans and verifies the shards: shard, doc_id, offset, length (of the record), tokens_before (in the shard), n_tokens, ids_crc32."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(value.as_buffer())
                shard, at, before = path.rsplit("/", 1)[-1], 0, 0
                out: list[tuple] = []
                while at < len(data):
                    doc_id, ids, after = read_record(data, at)
                    out.append((shard, doc_id, at, after - at, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, before = after, before + len(ids)
                kinds = (pa.string(), *[pa.int64()] * 6)
                columns = zip(*out, strict=True) if out else [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["shard", "doc_id", "offset", "length", "tokens_before", "n_tokens", "ids_crc32"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards").select("path", "content")
    return files.mapInArrow(scan, "shard string, doc_id long, offset long, length long, tokens_before long, n_tokens long, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the tokens of all documents before. Only one row a shard goes through the ungrouped window."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = totals.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("shard_start"))
    return index.join(before, "shard").withColumn("start", F.col("shard_start") + F.col("tokens_before"))


def shuffled_order(index: DataFrame, seed: int) -> DataFrame:
    """The index in a seeded order of reading, which depends on the seed and the record alone."""
    return index.orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset")


def encode(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Writes the records (to the shared folder, if none is named) and returns doc_id, start, n_tokens, ids_crc32, shard, offset, length."""
    folder = folder or scratch.new_path(docs.sparkSession, "records")
    index = write(docs, folder, tokenizer_path, id_col, text_col, end_id, shard_bytes)
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")
