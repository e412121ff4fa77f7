"""Vectorised words, word hashes and shingles of UTF-8 text."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words are runs of anything but ASCII white space."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    non = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], non[:-1]]) & ~edge[:-1]
    after = np.concatenate([non[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(non & ~before), np.flatnonzero(non & ~after) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, scrambled."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``width`` words; a document of fewer words, but any, has one of all of them."""
    start, end, doc = word_spans(raw, at)
    if not len(start):
        return doc, np.zeros(0, np.uint64)
    h = word_hashes(raw, start, end)
    first = np.searchsorted(doc, np.arange(len(at) - 1), side="left")
    count = np.searchsorted(doc, np.arange(len(at) - 1), side="right") - first
    out, m = np.zeros(max(0, len(h) - width + 1), np.uint64), len(h) - width + 1
    for i in range(width):
        if m > 0:
            out = mix(out + h[i : i + m] + np.uint64(i))
    whole = doc[: max(0, m)] == doc[width - 1 :] if m > 0 else np.zeros(0, bool)
    docs, values = doc[: max(0, m)][whole], out[whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for d in short.tolist():
            v = np.zeros(1, np.uint64)
            for i in range(count[d]):
                v = mix(v + h[first[d] + i : first[d] + i + 1] + np.uint64(i))
            extra.append(v[0])
        docs, values = np.concatenate([docs, short]), np.concatenate([values, np.array(extra, np.uint64)])
        order = np.argsort(docs, kind="stable")
        docs, values = docs[order], values[order]
    return docs, values
