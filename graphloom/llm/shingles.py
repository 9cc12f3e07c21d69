"""Vectorised 5-word shingles: 64-bit hashes of a batch of whole texts in a few numpy passes."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes of text hashed at once.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_powers.made[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers.made = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers.made[0][:n], _powers.made[1][:n]


_powers.made = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def word_hashes(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of the bytes, A-Z lower-cased or not."""
    solid = np.empty(len(data) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_BLANK[data]
    edges = np.diff(solid)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mixed(h + (ends - starts).astype(np.uint64) * _STEPS[0])


def _joined(w: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    out = np.full(len(at), count, np.uint64)
    for k in range(count):
        out += w[at + k] * _STEPS[k]
    return mixed(out)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles of each text, ordered by both.

    A text with fewer than WORDS words has its whole word sequence as the one shingle; without a word it has none.
    """
    owners, hashes, lo = [], [], 0
    while lo < len(texts):
        size, hi = 0, lo
        raw: list[bytes] = []
        while hi < len(texts) and (hi == lo or size < SLICE):
            raw.append((texts[hi] or "").encode("utf-8", "replace"))
            size += len(raw[-1]) + 1
            hi += 1
        doc_at = np.cumsum([0] + [len(x) + 1 for x in raw[:-1]])
        data = np.frombuffer(b" ".join(raw), np.uint8)
        starts, w = word_hashes(data)
        owner = np.searchsorted(doc_at, starts, side="right") - 1
        n = np.bincount(owner, minlength=len(raw))
        first = np.cumsum(n) - n
        full = np.flatnonzero(owner[: max(0, len(w) - WORDS + 1)] == owner[WORDS - 1 :]) if len(w) >= WORDS else np.empty(0, np.int64)
        o, h = [owner[full]], [_joined(w, full, WORDS)]
        for k in range(1, WORDS):
            few = np.flatnonzero(n == k)
            o.append(few)
            h.append(_joined(w, first[few], k))
        o, h = np.concatenate(o), np.concatenate(h)
        order = np.lexsort((h, o))
        o, h = o[order], h[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        owners.append(o[new] + lo)
        hashes.append(h[new])
        lo = hi
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)
