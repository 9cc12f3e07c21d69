"""Removal of long byte repeats by merging the Burrows-Wheeler transforms of shards.

A byte of a text goes when a LENGTH-byte string covers it that also starts in a text of a smaller id.

1. Every LENGTH bytes hold an anchor that their content chooses. A table of fixed size says which
   anchors occur in a single text only; strings around those cannot repeat and leave here.
2. The strings around the other anchors are named by hash. Copies of a whole string in larger texts
   are settled by the name (most of the removed bytes of copied texts are found here, not by the merge);
   what is left are anchors with different strings that share the bytes on one side. Verdicts go back
   to the chunk of texts that they are about, which joins them to one row a text.
3. Each task gathers the strings around those, as far as that side goes, keeps the smallest text's copy of equal ones, and packs,
   for each anchor range, the strings' Burrows-Wheeler transform: a shard.
4. The shards of a range are merged by refining their interleave two bytes a step with the transforms'
   own last-to-first steps; no suffix is sorted again. A border that first shows after n bytes tells a
   common prefix shorter than n; single rows leave, and what is together after LENGTH bytes is a repeat
   interval. Only rows that LENGTH bytes of their string precede take part, as no other row can end a repeat.
5. In each interval, starts in texts other than the smallest are marked; marked strings are joined to
   runs of bytes per text.

Defined results: null is an empty text; texts under LENGTH bytes lose nothing; rows repeated in id
count as one text among themselves; a null id keeps its text; extra columns are not read. Matches are
judged on the input, overlaps count, and no string spans two texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.anchors import GRAM, LENGTH, anchor_runs, gathered, prefix_sums
from graphloom.llm.common import releasing, small_batches, staged
from graphloom.llm.frequency import ROWS, class_table, classes_of
from graphloom.llm.shingles import _powers, mixed

#: Bytes of gathered strings in a merge, about; and in a task before it packs them as shards.
MERGE_BYTES, SHARD_BYTES = 1 << 20, 8 << 20
#: Runs of repeat starts that a task, or the count of an anchor range, holds at once.
HELD_RUNS = 250_000
#: Bytes beside an anchor: half of what a repeat has besides it.
SIDE = (LENGTH - GRAM) // 2


def _anchor_hashes(texts: list[str | None]) -> np.ndarray:
    """The distinct anchors of each text."""
    found = []
    for _, data, starts in gathered(texts):
        row, _, _, _, h = anchor_runs(data, starts)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
        found.append(h[new])
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def suffix_order(text: np.ndarray, most: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``most`` bytes or more; a 0 ends a string, and 0s rank by place."""
    n = len(text)
    rank = np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes at first
        key = key << np.uint64(8) | padded[k : k + n]
    del padded
    # nothing behind a string's end may decide: the bytes behind a 0 read as 0
    ends = np.flatnonzero(text == 0)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    cut = np.minimum(to_end, 7).astype(np.uint64)
    key = key >> ((np.uint64(7) - cut) * np.uint64(8)) << ((np.uint64(7) - cut) * np.uint64(8))
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.append(True, k[1:] != k[:-1])
    # strings that end within the key never tie: each is a class of its own, by place
    head |= to_end[order] < 7
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first
    width = 7
    while width < most:
        # only rows that share their class with others move
        size = np.bincount(first, minlength=n)
        open_ = np.flatnonzero(size[first] > 1)
        if not len(open_):
            break
        rows = order[open_]
        nxt = rank[np.minimum(rows + width, n - 1)]
        o = np.lexsort((rows, nxt, first[open_]))
        rows, cls, nxt = rows[o], first[open_][o], nxt[o]
        order[open_] = rows
        head = np.append(True, (cls[1:] != cls[:-1]) | (nxt[1:] != nxt[:-1]))
        new = np.maximum.accumulate(np.where(head, open_, 0))
        first = first.copy()
        first[open_] = new
        rank[rows] = new
        width *= 2
    return order


def transform(strings: list[bytes]) -> bytes:
    """The Burrows-Wheeler transform of 0-ended strings: rows in suffix order, the byte before each (0 before a string's first)."""
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    order = suffix_order(text, max(map(len, strings)) + 1)
    return text[order - 1].tobytes()


def merged_intervals(shards: list[np.ndarray], length: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval): the rows, numbered through all shards, whose suffixes share their first ``length`` bytes with another's.

    ``rows`` come in merged order; given some in order to begin with, only these are refined. Step by step each
    kept row moves to the row of the suffix that is longer by a byte, or by two, and a stable sort by these
    bytes refines the interleave; rows alone in their run leave.
    """
    last = np.concatenate(shards)
    base = np.cumsum([0, *map(len, shards)])
    forward = np.empty(len(last), np.int32 if len(last) < 2**31 else np.int64)
    for s, b in zip(shards, base):
        forward[np.argsort(s, kind="stable") + b] = np.arange(len(s)) + b
    rows = (np.arange(len(last)) if rows is None else rows).astype(forward.dtype)
    run = np.zeros(len(rows), np.int32)
    two, pairs = forward[forward], last[forward].astype(np.uint16)
    pairs = np.where((last > 0) & (pairs > 0), pairs << 8 | last, 0).astype(np.uint16)
    steps = [(last, forward)] * (length % 2) + [(pairs, two)] * (length // 2)
    for code, to in steps:
        c = code[rows]
        keep = np.flatnonzero(c)  # what would start with a string's end is no repeat
        if not len(keep):
            return rows[:0], run[:0]
        c = c[keep]
        order = np.argsort(c, kind="stable")
        c, order = c[order], keep[order]
        run, rows = run[order], to[rows[order]]
        head = np.append(True, (c[1:] != c[:-1]) | (run[1:] != run[:-1]))
        keep = np.flatnonzero(~(head & np.append(head[1:], True)))
        run = np.cumsum(head, dtype=np.int32)[keep]
        rows = rows[keep]
    return rows, run


def row_places(shard: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of each row of a shard, by walking all its strings backwards at once."""
    n = len(sizes)
    forward = np.empty(len(shard), np.int64)
    forward[np.argsort(shard, kind="stable")] = np.arange(len(shard))
    string, place = np.zeros(len(shard), np.int32), np.zeros(len(shard), np.int32)
    at, left, who = np.arange(n), sizes.astype(np.int64), np.arange(n)  # the rows of the ends come first, string by string
    while len(at):
        string[at], place[at] = who, left
        live = left > 0
        at, left, who = forward[at[live]], left[live] - 1, who[live]
    return string, place


def _candidates(batches: Iterator[pa.RecordBatch], table: bytes, bits: int) -> Iterator[tuple]:
    """For slices of text: (doc, start, span, anchor hash, name of the string, left, right, bytes, first, end, anchor) of the runs whose anchor's class is not 0.

    A repeat around an anchor holds its SIDE bytes to the left, or as many to the right: ``left`` and
    ``right`` are short hashes of the anchor with either, 0 where no start of the run reaches there.
    """
    for b in batches:
        for part in (b.slice(lo, ROWS) for lo in range(0, b.num_rows, ROWS)):
            ids = part.column("doc").to_numpy()
            for first, data, starts in gathered(part.column("__t").to_pylist()):
                sums = prefix_sums(data)
                row, lo, hi, at, h = anchor_runs(data, starts, sums)
                pick = np.flatnonzero(classes_of(h, table, bits))
                if not len(pick):
                    continue
                row, lo, hi, at, h = row[pick], lo[pick], hi[pick], at[pick], h[pick]
                end = hi + LENGTH
                down = _powers(len(data) + 1)[1]
                hashed = lambda a, z: mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
                a, z = np.maximum(at - SIDE, lo), np.minimum(at + GRAM + SIDE, end)
                left = np.where(lo <= at - SIDE, (hashed(a, at + GRAM) >> np.uint64(32)) | np.uint64(1), np.uint64(0)).astype(np.uint32)
                right = np.where(hi >= at - SIDE, (hashed(at, z) >> np.uint64(32)) | np.uint64(1), np.uint64(0)).astype(np.uint32)
                yield ids[first + row], (lo - starts[row]).astype(np.int32), (hi - lo + 1).astype(np.int32), h, hashed(lo, end), left, right, data, lo, end, at


def _side(h: np.ndarray, part: np.ndarray, salt: int, split: int) -> np.ndarray:
    """A hash of anchor and side that stays in the anchor's range."""
    x = mixed(h + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    return (h >> np.uint64(64 - split) << np.uint64(64 - split)) | (x >> np.uint64(split)) if split else x


def _least_of(doc: np.ndarray, start: np.ndarray, h: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, least): rows ordered by anchor, string, text and place, and the smallest text of each one's string."""
    order = np.lexsort((start, doc, name, h))
    head = np.append(True, (h[order][1:] != h[order][:-1]) | (name[order][1:] != name[order][:-1]))[: len(order)]
    return order, doc[order][np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if c[0] is None or isinstance(c[0], int) else pa.array([x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in c], pa.binary()) for c in cols], names=names)


_NAMED = ["chunk", "bucket", "h", "name", "left", "right", "doc", "start", "span"]


def _named_strings(docs: DataFrame, table: bytes, bits: int, split: int) -> DataFrame:
    """The runs by anchor range and by chunk of a task, with hashes of their strings only; runs that the task settles by itself ride along without."""
    bundle = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        chunk = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            doc, start, span, h, name, left, right = (np.concatenate([x[k] for x in held]) for k in range(7))
            order, least = _least_of(doc, start, h, name)
            settled = doc[order] > least
            gone, kept = np.sort(order[settled]), order[~settled]
            rows = [(chunk, k, b"", b"", b"", b"", doc[ids], start[ids], span[ids]) for k, ids in enumerate(np.array_split(gone, 1 << split)) if len(ids)]  # in step with the ranges, so none is larger
            own = (h[kept] >> np.uint64(64 - split)).astype(np.int64) if split else np.zeros(len(kept), np.int64)
            for ids in np.split(kept, np.flatnonzero(np.diff(own)) + 1):  # kept is in order of the anchors
                ids = np.sort(ids)  # neighbours in a text compress well
                rows.append((chunk, int(h[ids[0]] >> np.uint64(64 - split)) if split else 0, h[ids], name[ids], left[ids], right[ids], doc[ids], start[ids], span[ids]))
            return _batch(rows, _NAMED)

        for found in _candidates(batches, bundle.value, bits):
            held.append(found[:7])
            size += len(found[0])
            if size >= HELD_RUNS:
                yield flush()
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield flush()

    return docs.mapInArrow(releasing(run), "chunk long, bucket long, h binary, name binary, left binary, right binary, doc binary, start binary, span binary")


def _settle(bits: int, split: int):
    """For an anchor range: for each chunk its runs whose whole string is in a smaller text; and, under no chunk, a table of the anchors' sides that different strings share."""

    def shared(h: np.ndarray, side: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Rows of the (anchor, side) pairs that go with two names or more."""
        some = np.flatnonzero(side)
        order = some[np.lexsort((name[some], side[some], h[some]))]
        if not len(order):
            return order
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (side[order][1:] != side[order][:-1]))
        other = new | np.append(True, name[order][1:] != name[order][:-1])
        head = np.flatnonzero(new)
        return order[head[np.add.reduceat(other.astype(np.int64), head) > 1]]

    def settle(t: pa.Table) -> pa.Table:
        live = pc.greater(pc.binary_length(t.column("h")), 0)
        rest, t = t.filter(pc.invert(live)), t.filter(live)
        get = lambda name, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(v.as_py(), kind) for v in t.column(name)]])
        h, name, left, right = get("h", "<u8"), get("name", "<u8"), get("left", "<u4"), get("right", "<u4")
        doc, start, span = get("doc", "<i8"), get("start", "<i4"), get("span", "<i4")
        ends = np.cumsum([0, *(len(v.as_py()) // 8 for v in t.column("h"))])
        order, least = _least_of(doc, start, h, name)
        gone = np.zeros(len(doc), bool)
        gone[order] = doc[order] > least
        table = np.zeros(1 << (bits - split), np.uint8)
        for side, salt in ((left, 1), (right, 2)):
            ids = shared(h, side, name)
            table[(_side(h[ids], side[ids], salt, split) << np.uint64(split) >> np.uint64(64 - (bits - split))).astype(np.int64)] = 1
        q = table.reshape(-1, 4)
        packed = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
        rows = [tuple(r.values()) for r in rest.select(["chunk", "bucket", "h", "doc", "start", "span"]).to_pylist()]
        bucket = (t if t.num_rows else rest).column("bucket")[0].as_py()
        for c, a, z in zip(t.column("chunk").to_pylist(), ends, ends[1:]):
            if len(ids := np.flatnonzero(gone[a:z]) + a):
                rows.append((c, bucket, b"", doc[ids], start[ids], span[ids]))
        rows.append((None, bucket, packed.tobytes(), b"", b"", b""))
        return pa.Table.from_batches([_batch(rows, ["chunk", "bucket", "table", "doc", "start", "span"])])

    return settle


def _shards(docs: DataFrame, table: bytes, sides: bytes, bits: int, split: int, buckets: int) -> DataFrame:
    """(bucket, last, doc, start, size, span): the shards, by bucket, of the strings whose side ``sides`` marks, cut to the starts that reach there."""
    bundle, marked = docs.sparkSession.sparkContext.broadcast(table), docs.sparkSession.sparkContext.broadcast(sides)
    names = ["bucket", "last", "doc", "start", "size", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, start, span, h, name = (np.concatenate([x[k] for x in held]) for k in range(5))
            strings = [s for x in held for s in x[5]]
            order, least = _least_of(doc, start, h, name)
            kept = order[doc[order] == least]  # other texts' copies are settled
            own = ((h[kept] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            turn = np.argsort(own, kind="stable")
            kept, own = kept[turn], own[turn]
            for k in np.split(np.arange(len(kept)), np.flatnonzero(np.diff(own)) + 1):
                ids = kept[k]
                mine = [strings[i] for i in ids]
                yield _batch([(int(own[k[0]]), transform(mine), doc[ids], start[ids], np.array(list(map(len, mine)), np.int32), span[ids])], names)

        for doc, start, span, h, name, left, right, data, lo, end, at in _candidates(batches, bundle.value, bits):
            to_left = (left > 0) & (classes_of(_side(h, left, 1, split), marked.value, bits) > 0)
            to_right = (right > 0) & (classes_of(_side(h, right, 2, split), marked.value, bits) > 0)
            pick = np.flatnonzero(to_left | to_right)
            if not len(pick):
                continue
            # starts up to SIDE before the anchor hold its left side, starts from there on its right side
            first = np.where(to_left, lo, np.maximum(lo, at - SIDE))[pick]
            last = np.where(to_right, end - LENGTH, np.minimum(end - LENGTH, at - SIDE))[pick]
            doc, h, name = doc[pick], h[pick], mixed(name[pick] + to_left[pick] + np.uint64(2) * to_right[pick])
            start, span = (start[pick] + (first - lo[pick])).astype(np.int32), (last - first + 1).astype(np.int32)
            lo, end = first, last + LENGTH
            whole = (data + np.uint8(1)).tobytes()  # UTF-8 holds no 255, so 0 is free to end strings
            held.append((doc, start, span, h, name, [whole[a:z] for a, z in zip(lo.tolist(), end.tolist())]))
            size += int((end - lo).sum())
            if size >= SHARD_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(releasing(run), "bucket long, last binary, doc binary, start binary, size binary, span binary")


def _by_doc(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """(doc, spans): the spans [lo, hi) of each text joined where they touch, packed as pairs of longs."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(doc):
        return pa.table({"doc": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    # within a text the ends only grow, once each is raised to the largest before it
    text = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    reach = np.maximum.accumulate(hi + text * (1 << 40)) - text * (1 << 40)
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])))
    pairs = np.stack([lo[new], reach[np.append(new[1:], len(doc)) - 1]], axis=1).astype("<i8")
    first = np.flatnonzero(np.append(True, doc[new][1:] != doc[new][:-1]))
    return pa.table({"doc": pa.array(doc[new][first], pa.int64()), "spans": pa.array([x.tobytes() for x in np.split(pairs, first[1:])], pa.binary())})


def _merge(t: pa.Table) -> pa.Table:
    """(doc, spans) of the repeats that the merge of one bucket's shards finds."""
    get = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(name)]
    last, doc, start, size, span = get("last", np.uint8), get("doc", "<i8"), get("start", "<i4"), get("size", "<i4"), get("span", "<i4")
    strings, places = row_places_all(last, size)
    rows, run = merged_intervals(last, LENGTH, np.flatnonzero(places >= LENGTH))
    doc, start, span = np.concatenate(doc), np.concatenate(start), np.concatenate(span)
    string, place = strings[rows], places[rows]
    own = place < span[string]  # later places of a string are the business of its next anchor
    string, place, run = string[own], place[own], run[own]
    d, at = doc[string], start[string].astype(np.int64) + place
    if not len(d):
        return _by_doc(d, at, at)
    order = np.lexsort((d, run))
    head = np.append(True, np.diff(run[order]) != 0)
    least = d[order][np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
    marked = order[d[order] > least]
    return _by_doc(d[marked], at[marked], at[marked] + LENGTH)


def _settled_spans(t: pa.Table) -> pa.Table:
    """(doc, spans) of the settled runs of a chunk."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(name)]).astype(np.int64)
    start = get("start", "<i4")
    return _by_doc(get("doc", "<i8"), start, start + get("span", "<i4") + (LENGTH - 1))


def row_places_all(last: list[np.ndarray], size: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    parts, before = [], 0
    for s, z in zip(last, size):
        string, place = row_places(s, z)
        parts.append((string + before, place))
        before += len(z)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def repeat_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, spans): for each text that loses bytes, packed byte spans [lo, hi) that repeats of smaller ids cover, in no order."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__t")).where("doc is not null and __t is not null")
    total = own.agg(F.sum(F.octet_length("__t"))).first()[0] or 0
    table, bits = class_table(own.select("__t"), _anchor_hashes, total // 16)
    split = max(0, min(math.ceil(math.log2(max(1.0, total / 40 / HELD_RUNS))), bits - 2))
    settled = staged(_named_strings(own, table, bits, split).groupBy("bucket").applyInArrow(_settle(bits, split), "chunk long, bucket long, table binary, doc binary, start binary, span binary"), "suffix-settled")
    sides = bytearray(1 << (bits - 2))
    width = len(sides) >> split
    for r in settled.where("chunk is null").select("bucket", "table").toLocalIterator():  # together as large as the class table
        sides[r["bucket"] * width : (r["bucket"] + 1) * width] = r["table"]
    spans = "doc long, spans binary"
    local = settled.where("chunk is not null").select("chunk", "doc", "start", "span").groupBy("chunk").applyInArrow(_settled_spans, spans)
    shards = _shards(own, table, bytes(sides), bits, split, max(1, math.ceil(total / 8 / MERGE_BYTES)))
    merged = shards.groupBy("bucket").applyInArrow(_merge, spans)
    return merged.union(local).groupBy("doc").agg(F.collect_list("spans").alias("spans"))


def joined_spans(packed: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; spans that touch are one run."""
    every = np.frombuffer(b"".join(packed or []), "<i8").reshape(-1, 2)
    joined = _by_doc(np.zeros(len(every), np.int64), every[:, 0], every[:, 1]).column("spans").to_pylist()
    return [tuple(x) for x in np.frombuffer(joined[0], "<i8").reshape(-1, 2).tolist()] if joined else []


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the bytes that stay) and kept_sha256 of every row."""
    found = repeat_spans(docs, text, key)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__t"), F.col(key).cast("long").alias("doc")).join(found, "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                n, removed, count, kept = [], [], [], []
                for t, s in zip(part.column("__t").to_pylist(), part.column("spans").to_pylist()):
                    data = (t or "").encode("utf-8", "replace")
                    spans = joined_spans(s)
                    at, rest = 0, []
                    for a, z in spans:
                        rest.append(data[at:a])
                        at = z
                    rest.append(data[at:])
                    n.append(len(data))
                    removed.append(sum(z - a for a, z in spans))
                    count.append(len(spans))
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.select("__key", "__t", "spans").mapInArrow(releasing(run), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
