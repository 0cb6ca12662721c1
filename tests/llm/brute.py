"""Slow and plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def substring_dedup(rows, span=50):
    """rows: (id, text) pairs -> sorted (id, n_words, n_removed, sha256)."""
    words = [(i, BLANK.findall((t or "").encode())) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for j in range(len(w) - span + 1):
            k = tuple(w[j : j + span])
            if k not in first or order(i) < order(first[k]):
                first[k] = i
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - span + 1):
            if order(first[tuple(w[j : j + span])]) < order(i):
                gone[j : j + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_repeats(rows, span=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = defaultdict(int)
    for _, t in texts:
        for j in range(len(t) - span + 1):
            counts[t[j : j + span]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - span + 1):
            if counts[t[j : j + span]] > 1:
                gone[j : j + span] = b"\1" * span
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def decontaminate(docs, items, span=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words_of = lambda t: word.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for j in range(max(1, len(w) - span + 1) if w else 0):
            windows[tuple(w[j : j + span])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                k = tuple(w[j : j + n])
                if k in windows:
                    hit[j : j + n] = [True] * n
                    found |= windows[k]
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out


def records(docs, path, end=2):
    """docs: (id, text); rows (id, start, n_tokens, crc32) in ascending id order."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, start = [], 0
    for i, x in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def shingle_counts(text, width=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall((text or "").translate(lower))
    counts = defaultdict(int)
    for j in range(max(1, len(w) - width + 1) if w else 0):
        counts[tuple(w[j : j + width])] += 1
    return counts


def idf_weights(docs, damping=0.5, rare=1024):
    """shingle -> factor, from exact document frequencies."""
    import math

    df = defaultdict(int)
    for _, t in docs:
        for s in shingle_counts(t):
            df[s] += 1
    return lambda s: 1 + damping * min(1, max(0, math.log(len(docs) / df[s]) / math.log(rare)))


def near_classes(docs, weights_of, threshold=0.8, width=5):
    """docs: (id, text) with distinct ids; {id: class id}, from all pairs that share a shingle. weights_of: shingle -> factor."""
    sets, holders = {}, defaultdict(list)
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        t = t or ""
        if t in first:
            parent[i] = first[t]
            continue
        first[t] = i
        sets[i] = {s: n * weights_of(s) for s, n in shingle_counts(t, width).items()}
        for s in sets[i]:
            holders[s].append(i)
    pairs = {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        least = sum(min(v, y.get(s, 0)) for s, v in x.items())
        if least / (sum(x.values()) + sum(y.values()) - least) >= threshold:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in docs}
