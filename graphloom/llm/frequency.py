"""A table of fixed size with the frequency class of hashed items, counted over all rows.

Tasks sort their hashes and send them, four bytes each, to the task of their hash range; that task
counts them exactly and keeps two bits for each slot: the class of its most frequent item. Class 0
is certain: every item of the slot occurred once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import releasing

#: Counts at which the classes 1, 2 and 3 begin.
CLASSES = (2, 8, 64)
#: Bits of the table's address, at least and at most: it never takes more than 2**28 / 4 bytes.
TABLE_BITS = (16, 28)
#: Items of a range of the count.
RANGE_ITEMS = 2_000_000
#: Rows whose texts are in Python's hands at once.
ROWS = 500


def classes_of(h: np.ndarray, table: bytes, bits: int) -> np.ndarray:
    slot = h >> np.uint64(64 - bits)
    return (np.frombuffer(table, np.uint8)[slot >> np.uint64(2)] >> ((slot & np.uint64(3)).astype(np.uint8) * 2)) & 3


def class_table(texts: DataFrame, hashes: Callable[[list[str | None]], np.ndarray], total: int, spare: int = 1) -> tuple[bytes, int]:
    """(table, bits) for the items that ``hashes`` finds in the one column of ``texts``; ``total`` is about their number, 2**spare slots stand for each."""
    bits = min(max(math.ceil(math.log2(max(total, 2))) + spare, TABLE_BITS[0]), TABLE_BITS[1])
    split = max(0, min(math.ceil(math.log2(max(1.0, total / RANGE_ITEMS))), bits - 2))

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            cuts = np.searchsorted(h >> np.uint64(64 - split), np.arange(1 << split, dtype=np.uint64)) if split else np.zeros(1, np.int64)
            ends = np.append(cuts[1:], len(h))
            rest = (h << np.uint64(split) >> np.uint64(32)).astype("<u4")
            found = [(i, rest[a:z].tobytes()) for i, (a, z) in enumerate(zip(cuts, ends)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                h = hashes(b.column(0).slice(lo, ROWS).to_pylist())
                held.append(h)
                size += len(h)
                if size > RANGE_ITEMS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        x = np.sort(np.concatenate([np.frombuffer(v.as_py(), "<u4") for v in t.column("blob")]))
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        level = np.digitize(np.diff(np.append(first, len(x))), CLASSES).astype(np.uint8)
        table = np.zeros(1 << (bits - split), np.uint8)
        at = (x[first] >> np.uint32(32 - (bits - split))).astype(np.int64)
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        table[at[head]] = np.maximum.reduceat(level, head)
        q = table.reshape(-1, 4)
        packed = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "table": pa.array([packed.tobytes()], pa.binary())})

    counted = texts.mapInArrow(releasing(blobs), "bucket long, blob binary").groupBy("bucket").applyInArrow(count, "bucket long, table binary")
    whole = bytearray(1 << (bits - 2))
    width = len(whole) >> split
    # at most 2**28 / 4 bytes in one job; an iterator over partitions would run one job for each
    found = counted.toArrow()
    for bucket, part in zip(found.column("bucket").to_pylist(), found.column("table")):
        whole[bucket * width : (bucket + 1) * width] = part.as_py()
    return bytes(whole), bits
