"""Line dedup by winnowing over line hashes: runs that repeat earlier ones are deleted, the first run stays.

1. Every window of RUN consecutive lines with a word selects the least of its line hashes. Positions
   where a minimum is selected are the fingerprints; any two texts that share a window share one.
2. A table of fixed size tells which fingerprints occur once; their windows cannot repeat and leave.
3. The positions of equal fingerprints are joined: each is compared, line by line to both sides as far as
   its windows reach, with the earliest of its like. Windows that begin earlier elsewhere, by id and then
   by place, are repeats; neighbouring ones carry a match on both ways, up to maximal runs.

A task settles repeats of its own strings by itself and sends one place for each, so a passage that
a third of all texts share is a row a task. With ``words`` the guarantee also depends on what a run
holds: windows of one or two lines of that many words together count too, so every repeated run of
RUN lines, or of ``words`` words, is sure to go.

Defined results: a null text stays null and has no lines; lines without a word never match and stay;
texts with fewer than RUN lines lose nothing but runs of ``words`` words; a text that loses every line is
empty; rows repeated in id are at one place and do not delete each other; a null id keeps its text; an
empty table gives an empty table; extra columns pass through, whatever their names, but n_lines,
n_removed_lines and n_runs of the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WORD_RE, as_row, releasing, small_batches, staged
from graphloom.llm.frequency import ROWS, class_table, classes_of
from graphloom.llm.shingles import mixed

#: Lines of a window: any repeated run of as many is sure to be found.
RUN = 3
#: Windows that a task holds before it hands them on.
HELD = 500_000
BLANKS = " \t\x0b\x0c\r"
WORD = re.compile(WORD_RE)
ADDED = {"n_lines", "n_removed_lines", "n_runs"}


def worded(text: str | None) -> tuple[list[str], list[int]]:
    """The lines of a text, and which of them hold a word."""
    lines = text.split("\n") if text is not None else []
    return lines, [i for i, x in enumerate(lines) if x.strip(BLANKS)]


def windows(lines: list[str], at: list[int], words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, fingerprint, its place, content) of each window of RUN lines with a word, and of each shorter one of ``words`` words.

    The fingerprint is the least line hash of the window, the first of equal ones, mixed again so that it is spread evenly; ``content`` names all its lines.
    """
    h = np.array([xxhash.xxh3_64_intdigest(lines[i]) for i in at], np.uint64)
    held = np.array([len(WORD.findall(lines[i])) for i in at] if words else [], np.int64)
    out = []
    for length in range(1 if words else RUN, RUN + 1):
        n = max(0, len(h) - length + 1)
        content = np.full(n, 0 if length == RUN else length, np.uint64)  # windows of different lengths are different
        least, spot = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.arange(n)
        for k in range(length):
            content = (content ^ (content >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            lower = h[k : k + n] < least
            least, spot = np.where(lower, h[k : k + n], least), np.where(lower, np.arange(k, k + n), spot)
        place = np.arange(n)
        if length < RUN:
            place = np.flatnonzero(sum(held[k : k + n] for k in range(length)) >= words)
        out.append((place, np.full(len(place), length), mixed(least[place]), spot[place], content[place]))
    place, size, mark, spot, content = (np.concatenate(x) for x in zip(*out))
    return place, size, mark, spot, content


def fingerprints(mark: np.ndarray, size: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """The fingerprints of a text, once for each stretch of windows that selects the same line."""
    return mark[np.append(True, (spot[1:] != spot[:-1]) | (size[1:] != size[:-1]))[: len(mark)]]


def repeated_windows(docs: DataFrame, text: str, key: str, words: int | None = None) -> DataFrame:
    """(doc, starts): the windows of each text, by place and length, that repeat an earlier one."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__t")).where("doc is not null and __t is not null")

    def selected(texts: list[str]) -> np.ndarray:
        found = [np.empty(0, np.uint64)]
        for t in texts:
            _, size, mark, spot, _ = windows(*worded(t), words)
            found.append(fingerprints(mark, size, spot))
        return np.concatenate(found)

    # a line in two is selected, about
    total = own.agg(F.sum(F.length("__t") - F.length(F.replace("__t", F.lit("\n"))) + 1)).first()[0] or 0
    table, bits = class_table(own.select("__t"), selected, total // 2)
    bundle = docs.sparkSession.sparkContext.broadcast(table)  # of at most 2**28 / 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            doc, place, size, mark, content = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, doc, content, size))
            doc, place, size, mark, content = (x[order] for x in (doc, place, size, mark, content))
            new = np.append(True, (content[1:] != content[:-1]) | (size[1:] != size[:-1]))[: len(doc)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            later = (doc != doc[first]) | (place != place[first])  # the task has seen an earlier one
            keep = later | new  # rows repeated in id are at one place
            name = pa.array(content.view(np.int64)[keep], mask=later[keep])
            mark = pa.array(mark.view(np.int64)[keep], mask=later[keep])
            return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep]), pa.array(size[keep]), mark, name], names=["doc", "place", "size", "mark", "content"])

        for b in batches:
            for d, t in zip(b.column("doc").to_pylist(), b.column("__t").to_pylist()):
                place, size, mark, _, content = windows(*worded(t), words)
                pick = np.flatnonzero(classes_of(mark, bundle.value, bits))
                held.append((np.full(len(pick), d, np.int64), place[pick], size[pick], mark[pick], content[pick]))
                count += len(pick)
                if count > HELD:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    found = staged(own.mapInArrow(releasing(run), "doc long, place long, size long, mark long, content long"), "line-windows")
    like = ["mark", "size", "content"]
    sent = found.where("content is not null")
    # one aggregate per window: its earliest place; a window seen once has no group of two
    first = sent.groupBy(*like).agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    later = sent.join(first, like).where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place"))).select("doc", "place", "size")
    return later.union(found.where("content is null").select("doc", "place", "size")).groupBy("doc").agg(F.collect_set(F.struct("place", "size")).alias("starts"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs of RUN lines, or of ``words`` words, deleted from ``text``, and n_lines (with a word), n_removed_lines and n_runs."""
    fields = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    names = [f.name for f in fields]
    starts = repeated_windows(docs, text, key, words).select(F.col("doc").alias("__doc"), F.col("starts").alias("__starts"))
    rows = docs.select(as_row(docs, names), docs[f"`{text}`"].alias("__t"), docs[f"`{key}`"].cast("long").alias("__key")).join(starts, F.col("__key") == F.col("__doc"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            out, n, gone, runs = [], [], [], []
            for t, s in zip(b.column("__t").to_pylist(), b.column("__starts").to_pylist()):
                lines, at = worded(t)
                hit = np.zeros(len(at), bool)
                for w in s or []:
                    hit[w["place"] : w["place"] + w["size"]] = True
                drop = {at[i] for i in np.flatnonzero(hit)}
                out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t)
                n.append(len(at))
                gone.append(len(drop))
                runs.append(int(np.count_nonzero(np.diff(np.append(0, hit.astype(np.int8))) == 1)))
            carried = b.column("__row").flatten()
            cols = [pa.array(out, pa.string()) if x == text else carried[i] for i, x in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=[*names, "n_lines", "n_removed_lines", "n_runs"])

    schema = T.StructType([*fields, *[T.StructField(x, T.LongType()) for x in ("n_lines", "n_removed_lines", "n_runs")]])
    return rows.select("__row", "__t", "__starts").mapInArrow(releasing(run), schema)
