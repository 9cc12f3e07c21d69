"""Content-chosen anchors of byte strings: every LENGTH bytes hold one, and equal strings choose it alike."""

from __future__ import annotations

import numpy as np

from graphloom.llm.shingles import _powers, mixed

#: Bytes of a repeat, of an anchor, and the anchor places in a repeat.
LENGTH, GRAM = 50, 20
PLACES = LENGTH - GRAM + 1
#: Bytes handled at once; the place of an anchor takes the low bits of its sort key.
SLICE = 1 << 18
_PLACE_BITS = 24


def gathered(texts: list[str | None]):
    """(first row, bytes of the rows end to end, start of each row) for slices of about SLICE bytes."""
    lo = 0
    while lo < len(texts):
        raw, size, hi = [], 0, lo
        while hi < len(texts) and (hi == lo or size < SLICE):
            raw.append((texts[hi] or "").encode("utf-8", "replace"))
            size += len(raw[-1])
            hi += 1
        yield lo, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys, from block minima running both ways."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, starts: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, anchor, hash): the runs of repeat starts first..last whose anchor is the same one; places count from the slice."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, np.empty(0, np.uint64)
    sums = prefix_sums(data) if sums is None else sums
    _, down = _powers(len(data) + 1)
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    if len(data) >= 1 << _PLACE_BITS:  # one huge text: anchors of overlapping parts are those of the whole
        parts, step = [], (1 << _PLACE_BITS) - LENGTH
        for lo in range(0, len(h) - PLACES + 1, step):
            part = h[lo : lo + step + PLACES - 1]
            parts.append((_least((part & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(part), dtype=np.uint64), PLACES) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + lo)
        place = np.concatenate(parts)
    else:
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        place = (_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), PLACES) & mask).astype(np.int64)
    # a start is good when its LENGTH bytes stay in its row
    row_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
    good = np.arange(len(place)) + LENGTH <= starts[row_of + 1]
    at = np.flatnonzero(good)
    if not len(at):
        return none, none, none, none, np.empty(0, np.uint64)
    p = place[at]
    head = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)))
    tail = np.append(head[1:], len(at)) - 1
    # the least of PLACES hashes is small: mixed again, equal shares of the anchors fall in every range
    return row_of[at[head]], at[head], at[tail], p[head], mixed(h[p[head]])
