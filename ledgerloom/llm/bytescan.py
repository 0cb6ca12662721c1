"""Vectorised scanning of UTF-8 text: words, rolling (Rabin-Karp) hashes and winnowed anchors.

Two kinds of rolling hashes, both differences of prefix sums. Rolling works modulo 2**64: it is fast, but texts can be
made that clash (Thue-Morse words), so it only picks anchors, where a clash costs time and never a result. PrimeRolling
works modulo the prime 2**61 - 1, where n values clash with a chance of n / 2**61 at most, and says which windows
are equal. Words are hashed by their bytes, runs as a whole by xxh3. Work goes through arrays of a chunk of documents;
chunks are small enough to stay in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 18
LOW = 24
_LOW_MASK = np.uint64((1 << LOW) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PRIME = (1 << 61) - 1
_PRIME, _PRIME_BASE = np.uint64(PRIME), 0x1B5A_4C92_7E3D_60F1
_LOW31, _LOW30, _LOW32 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64((1 << 32) - 1)
_EIGHT = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_powers: list[np.ndarray] = []
_prime_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 15))
        _powers[:] = []
        for step in (_BASE, _INVERSE):
            out = np.full(size, step, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the one of splitmix64), so that low bits are as good as high ones."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        ahead, self.back = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * ahead[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, span: int) -> np.ndarray:
        """The hash of every slice of span values."""
        n = max(0, len(self.sums) - span)
        return mix((self.sums[span:] - self.sums[:n]) * self.back[:n])


def of_bytes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTES[data])


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo PRIME."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def prime_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below it. Halves of 31 bits keep all parts below 2**64, and 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + _reduced(a0 * b0))


def prime_powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i for i < n, modulo PRIME, by doubling."""
    if not _prime_powers or len(_prime_powers[0]) < n:
        _prime_powers[:] = []
        for step in (_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, prime_product(out, np.full(len(out), pow(step, len(out), PRIME), np.uint64))])
            _prime_powers.append(out)
    return _prime_powers


class PrimeRolling:
    """Hashes of any slice of a sequence of 64-bit values: polynomials modulo PRIME, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        ahead, self.back = prime_powers(n + 1)
        terms = prime_product(_reduced(values), ahead[:n])
        # Sums of halves of 32 bits don't overflow; 2**32 * high is taken apart in the same way.
        low, high = np.cumsum(terms & _LOW32), _reduced(np.cumsum(terms >> np.uint64(32)))
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _reduced(_reduced(low) + prime_product(high, np.full(n, 1 << 32, np.uint64)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return prime_product(_reduced(self.sums[ends] + (_PRIME - self.sums[starts])), self.back[starts])


def leading(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 and the next 8 bytes of slices, as numbers; what a slice lacks is 0."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    first = np.ascontiguousarray(eights[starts]).view("<u8").ravel() & _EIGHT[np.minimum(lengths, 8)]
    second = np.ascontiguousarray(eights[np.minimum(starts + 8, len(data))]).view("<u8").ravel() & _EIGHT[np.clip(lengths - 8, 0, 8)]
    return first, second


def slice_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each slice that, with its length, name it: its own bytes up to 16, and xxh3 beyond."""
    lengths = ends - starts
    first, second = leading(data, starts, lengths)
    view = memoryview(data)
    for i in np.flatnonzero(lengths > 16).tolist():
        both = xxhash.xxh3_128_intdigest(view[starts[i] : ends[i]])
        first[i], second[i] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
    return first, second


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxh3 of slices of values, as signed numbers."""
    view, size = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[s:e]) for s, e in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each; a longer text is alone."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield low, i
            low, size = i, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that what is made from a batch stays small beside it."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The values of a string column as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


class Words:
    """The words of some texts: data holds the texts, parted by spaces; first and count say which words each text has."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, table: bytes | None = None):
        joined = b" ".join([b"", *texts, b""])
        self.data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
        inside = ~separators[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
        cut = np.searchsorted(self.starts, self.offsets)
        self.first, self.count = cut[:-1], np.diff(cut)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length."""
        first, second = slice_keys(self.data, self.starts, self.ends)
        return mix(mix(first + (self.ends - self.starts).astype(np.uint64) * np.uint64(_BASE)) + second * np.uint64(_INVERSE))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: size - width], x[width - size :]) if width > size else x


def anchor_runs(values: np.ndarray, first: np.ndarray, count: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor (winnowing). values: bytes, or hashes of words.

    The windows are all slices of span values inside one document; a window's anchor is the leftmost
    least hash of its slices of gram values, so equal windows have equal anchors at equal places.
    Returns for each run: the document's index, the first window's start, the number of windows,
    the anchor's hash, and a hash of everything that the run's windows cover and of the anchor's place in it.
    """
    empty = np.zeros(0, np.int64)
    has = np.flatnonzero(count >= span)
    if not len(has):
        return empty, empty, empty, empty, empty
    grams = (of_bytes(values) if values.dtype == np.uint8 else Rolling(values)).windows(gram)
    segment = 1 << LOW
    parts = []
    for base in range(0, len(grams), segment - span):
        part = grams[base : base + segment]
        if len(part) < span - gram + 1:
            break
        keys = (part & ~_LOW_MASK) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(keys, span - gram + 1)[: segment - span]
        parts.append((least & _LOW_MASK).astype(np.int64) + base)
    anchors = np.concatenate(parts)
    windows = ragged(first[has], count[has] - span + 1)
    owner = np.repeat(has, count[has] - span + 1)
    anchors = anchors[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(windows)))
    start = windows[at]
    place = mix((anchors[at] - start).astype(np.uint64) * np.uint64(_BASE) + size.astype(np.uint64)).view(np.int64)
    return owner[at], start, size, grams[anchors[at]].view(np.int64), slice_hashes(values, start, start + size - 1 + span) ^ place


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]
