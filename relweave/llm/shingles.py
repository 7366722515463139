"""Flat numpy word and shingle hashes for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: ASCII white space separates words; A-Z are lower-cased; all other bytes stand for themselves.
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 256), _BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.cumprod(out, dtype=np.uint64)
    return _powers


def chunks(texts: list[str | None], chars: int = 600_000, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` characters and at most ``rows`` rows."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= chars or i + 1 - lo >= rows:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, and where each text's words end. Null counts as empty."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    size = stops - starts
    letters = data[inside]
    letters = (_LOWER[letters] if lower else letters).astype(np.uint64) + np.uint64(1)
    at = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(at, size)
    letters *= _power(int(size.max()))[place]
    return mix(np.add.reduceat(letters, at) + size.astype(np.uint64)), np.searchsorted(starts, text_end)


def shingle_hashes(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``k`` words, and where each text's shingles end. A text of 1 to k-1 words has one, its whole sequence."""
    starts = np.r_[0, ends[:-1]]
    n = ends - starts
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    first = np.repeat(starts - stop + count, count) + np.arange(total)
    padded = np.r_[words, np.zeros(k, dtype=np.uint64)]
    last = np.repeat(ends, count)
    out, q = np.zeros(total, dtype=np.uint64), 1
    for j in range(k):
        out += np.where(first + j < last, padded[first + j], np.uint64(0)) * np.uint64(q)
        q = q * int(_STEP) & _MASK
    return mix(out), stop


def text_shingles(texts: list[str | None], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    words, ends = word_hashes(texts, lower)
    return shingle_hashes(words, ends, k)


def distinct_sorted(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes, sorted and once each, and where they end."""
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(hashes) else np.zeros(0, dtype=bool)
    return hashes[keep], np.searchsorted(doc[keep], np.arange(len(ends)), side="right")


def sequence_hashes(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's whole word sequence (0 without words)."""
    starts = np.r_[0, ends[:-1]]
    n = ends - starts
    power = _power(int(n.max()) + 1 if len(n) else 1)[np.arange(len(words)) - np.repeat(starts, n)]
    out = []
    for salt in (0x1D8E4E27C47D124F, 0x5851F42D4C957F2D):
        total = np.r_[np.uint64(0), np.cumsum(mix(words ^ np.uint64(salt)) * power, dtype=np.uint64)]
        out.append(np.where(n > 0, mix(total[ends] - total[starts] + n.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]
