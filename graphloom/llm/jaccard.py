"""Exact Jaccard self-join of 5-word shingle sets: size-aware, heavy-light.

Equal sets collapse to their smallest id first. Shingles get one global order, rare before frequent,
from a table of fixed size that holds the class of every shingle's document frequency, counted over
all texts. A set of n shingles that can link has one of its first n - ceil(0.8 n) + 1 shingles in
common with its partner, so only those are posted, and none that occurs in a single document.

* Small sets (up to a size that the costs choose) enumerate their fixed-size subsets: two sets link
  when they share a subset as large as the overlap they need, so each subset's sets hang on its
  smallest set and nothing is verified.
* Larger sets scan inverted lists. Light lists give candidate pairs, which are verified set against
  set; heavy lists are scanned whole, in blocks of bounded sets and shingles, by counting overlaps. Sets
  that link with the first one of a heavy list are connected by that, so blocks of them do not meet.

Links only serve to connect, so no list emits all pairs of its sets. Defined results: a text without
words has an empty set and links with nothing, a null text likewise; an empty table gives an empty table; rows repeated in id and text count once; an
id with several texts has a set, and links, for each of them; a null id is
a row without links; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import releasing, shared_dir, small_batches, staged
from graphloom.llm.frequency import ROWS, class_table, classes_of
from graphloom.llm.shingles import mixed, shingle_sets
from graphloom.plans.components import components

#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets up to this size may enumerate subsets; the costs choose a boundary from 0 to here. Beyond, a set
#: has thousands of subsets (4845 at 20 shingles), more than its lists ever hold.
MOST_SMALL = 16
#: Rows moved for each pair that a list gives (told apart, met with either set) and for each subset (grouped, joined).
PAIR_ROWS, SUBSET_ROWS = 3, 2
#: Inverted lists with more sets than this are heavy.
HEAVY = 48
#: A set that more than one in so many rows hold is common; there are fewer of them than this.
COMMON = 1000
#: Shingles, and sets, of a block of a heavy list: a pair of blocks takes 50 MB, whatever the sets.
BLOCK_SHINGLES, BLOCK_SETS = 500_000, 1000


def needed(a: int, b: int) -> int:
    """The least overlap at which sets of sizes a and b link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def posted(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles are posted."""
    return n - (-(-PERCENT * n // 100)) + 1


def subset_sizes(n: int) -> list[int]:
    return sorted({needed(n, m) for m in range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1) if needed(n, m) <= min(n, m)})


def _sums(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two sums of the mixed hashes of each set, of sizes ``n``."""
    ends, sums = np.cumsum(n), []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(salt)))])
        sums.append((total[ends] - total[ends - n]).view(np.int64))
    return sums


def _summaries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, n, h1, h2): the size of each set and two sums of its mixed hashes, which name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            owner, h = shingle_sets(part.column("__t").to_pylist())
            n = np.bincount(owner, minlength=part.num_rows)
            sums = _sums(h, n)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["doc", "n", "h1", "h2"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__t")).mapInArrow(releasing(run), "doc long, n long, h1 long, h2 long")


def _posts(docs: DataFrame, key: str, text: str, table: bytes, bits: int) -> DataFrame:
    """(doc, n, h1, h2, toks, poss, shingles): for each set that may link, its posted shingles, their places, and all its shingles."""
    bundle = docs.sparkSession.sparkContext.broadcast(table)  # of at most 2**28 / 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                owner, h = shingle_sets(part.column("__t").to_pylist())
                if not len(h):
                    continue
                kind = classes_of(h, bundle.value, bits)
                n = np.bincount(owner, minlength=part.num_rows)
                first = np.cumsum(n) - n
                order = np.lexsort((h, kind, owner))
                place = np.arange(len(h)) - first[owner]  # owner is sorted, so order keeps its runs
                post = np.flatnonzero((place < posted(n)[owner]) & (kind[order] > 0))
                tok, pos = h[order][post], place[post]
                mine = np.bincount(owner[post], minlength=part.num_rows)
                some = np.flatnonzero(mine)
                cut = np.append(0, np.cumsum(mine[some]))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tok.view(np.int64)))
                places = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pos, pa.int64()))
                inside = (mine > 0)[owner]
                every = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[some])), pa.int32()), pa.array(h[inside].view(np.int64)))
                names = [pa.array(x[some]) for x in _sums(h, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(some)), pa.array(n[some], pa.int64()), *names, lists, places, every], names=["doc", "n", "h1", "h2", "toks", "poss", "shingles"])

    schema = "doc long, n long, h1 long, h2 long, toks array<long>, poss array<long>, shingles array<long>"
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__t")).where("doc is not null").mapInArrow(releasing(run), schema)


def _subset_links(sets: DataFrame, boundary: int) -> DataFrame:
    """Links among sets of up to ``boundary`` shingles: each hangs on the smallest set it shares a large enough subset with."""
    plans = {n: subset_sizes(n) for n in range(1, boundary + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, size, want, name = [], [], [], []
            for d, n, s in zip(b.column("doc").to_pylist(), b.column("n").to_pylist(), b.column("shingles").to_pylist()):
                s = np.array(sorted(s), np.int64).view(np.uint64)
                for c in plans[n]:
                    pick = np.array(list(combinations(range(n), c)))
                    code = np.zeros(len(pick), np.uint64)
                    for k in range(c):
                        code = mixed(code + s[pick[:, k]])
                    doc += [d] * len(pick)
                    size += [n] * len(pick)
                    want += [c] * len(pick)
                    name.append(code.view(np.int64))
            codes = np.concatenate(name) if name else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(want, pa.int64()), pa.array(codes)], names=["doc", "n", "c", "subset"])

    subsets = sets.where(F.col("n") <= boundary).select("doc", "n", "shingles").mapInArrow(run, "doc long, n long, c long, subset long")
    hub = subsets.groupBy("c", "subset").agg(F.min(F.struct("n", "doc")).alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    return subsets.join(hub, ["c", "subset"]).where((F.col("doc") != F.col("hub.doc")) & ((100 + PERCENT) * F.col("c") >= PERCENT * (F.col("n") + F.col("hub.n")))).select(F.col("hub.doc").alias("src"), F.col("doc").alias("dst"))


def _pair_links(posts: DataFrame, sets: DataFrame, folder_name: str) -> DataFrame:
    """Links from light lists: candidate pairs by length and place, verified on the sets."""
    a = posts.select("tok", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = posts.select("tok", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    enough = (100 + PERCENT) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= PERCENT * (F.col("na") + F.col("nb"))
    pairs = staged(a.join(b, "tok").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct(), folder_name)
    own = sets.select("doc", "shingles")
    left = pairs.join(own.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(own.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + PERCENT) * common >= PERCENT * (F.size("sa") + F.size("sb"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def overlap_links(docs: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Star edges of the components that the sets of one block pair form, by scanning its inverted lists.

    Frequent shingles add up as a matrix product, the others list by list.
    """
    n = len(docs)
    owner = np.repeat(np.arange(n), sizes)
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    overlap = np.zeros((n, n), np.float32)
    dense = np.flatnonzero(df > HEAVY)
    rank = np.full(len(df), -1, np.int64)
    rank[dense] = np.arange(len(dense))
    for lo in range(0, len(dense), 1024):
        m = np.zeros((n, min(1024, len(dense) - lo)), np.float32)
        r = rank[col] - lo
        inside = np.flatnonzero((r >= 0) & (r < m.shape[1]))
        m[owner[inside], r[inside]] = 1
        overlap += m @ m.T
    thin = np.flatnonzero((df[col] <= HEAVY) & (df[col] > 1))
    thin = thin[np.argsort(col[thin], kind="stable")]
    for run in np.split(owner[thin], np.flatnonzero(np.diff(col[thin])) + 1) if len(thin) else []:
        overlap[np.ix_(run, run)] += 1
    link = np.empty((n, n), bool)
    for lo in range(0, n, 256):
        link[lo : lo + 256] = (100 + PERCENT) * overlap[lo : lo + 256] >= np.float32(PERCENT) * (sizes[lo : lo + 256, None] + sizes[None, :]).astype(np.float32)
    del overlap
    left = np.ones(n, bool)
    out = []
    for i in np.argsort(docs, kind="stable"):
        if not left[i]:
            continue
        left[i] = False
        wave = np.array([i])
        while len(wave):
            nxt = np.flatnonzero(link[wave].any(axis=0) & left)
            left[nxt] = False
            out += [(int(docs[i]), int(docs[j])) for j in nxt]
            wave = nxt
    return out


def _block_links(posts: DataFrame, sets: DataFrame, lists: DataFrame) -> DataFrame:
    """Links from heavy lists: of each list's first set with all others, then of a bounded pair of blocks at a time.

    Only what the first set does not link with still has to meet every block: one share of near copies
    costs a row for each set, not one for each pair of blocks.
    """
    own = sets.select("doc", "shingles")
    first = posts.groupBy("tok").agg(F.min(F.struct("n", "doc")).alias("m")).select("tok", F.col("m.doc").alias("hub"), F.col("m.n").alias("hub_n"))
    near = posts.join(first, "tok").where((F.col("doc") != F.col("hub")) & (100 * F.col("hub_n") >= PERCENT * F.col("n")))
    both = near.select("doc", "n", "hub", "hub_n").distinct().join(own, "doc").join(own.select(F.col("doc").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    common = F.size(F.array_intersect("shingles", "of_hub"))
    stars = staged(both.where((100 + PERCENT) * common >= PERCENT * (F.col("n") + F.col("hub_n"))).select(F.col("hub").alias("src"), F.col("doc").alias("dst")), "jaccard-stars")

    linked = stars.select(F.col("src").alias("hub"), F.col("dst").alias("doc"), F.lit(True).alias("done"))
    done = F.coalesce("done", F.col("doc") == F.col("hub"))
    marked = staged(posts.join(first, "tok").join(linked, ["hub", "doc"], "left").select("tok", "doc", "n", done.alias("done")), "jaccard-heavy")
    # blocks of sets that the first one connects come apart from the blocks of the others
    shares = marked.groupBy("tok", "done").agg(F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count("*") / F.lit(BLOCK_SETS))).alias("parts"))
    parts = shares.groupBy("tok").agg(F.coalesce(F.max(F.when(F.col("done"), F.col("parts"))), F.lit(0)).alias("of_done"), F.coalesce(F.max(F.when(~F.col("done"), F.col("parts"))), F.lit(0)).alias("of_open"))
    entries = marked.join(parts.where("of_open > 0"), "tok")
    hashed = F.xxhash64("doc", "tok")
    entries = entries.withColumn("own", F.when(F.col("done"), -1 - F.pmod(hashed, F.greatest("of_done", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("of_open", F.lit(1)))))
    # blocks of the open sets, from 0 on, meet all blocks; those of the others, below 0, only these
    opens = F.sequence(F.lit(0).cast("long"), F.col("of_open") - 1)
    others = F.when(F.col("done") | (F.col("of_done") == 0), opens).otherwise(F.concat(opens, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("of_done", F.lit(1))), lambda k: -k)))
    entries = entries.withColumn("other", F.explode(others)).select("tok", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "doc", "n")
    full = entries.join(own, "doc")

    def scan(t: pa.Table) -> pa.Table:
        flat = t.column("shingles").combine_chunks()
        flat = (flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)).flatten().to_numpy()
        out = overlap_links(t.column("doc").to_numpy(), t.column("n").to_numpy(), flat)
        return pa.table({"src": pa.array([a for a, _ in out], pa.int64()), "dst": pa.array([b for _, b in out], pa.int64())})

    return stars.union(full.groupBy("tok", "x", "y").applyInArrow(scan, "src long, dst long").distinct())


def boundary_by_cost(posts: DataFrame, lists: DataFrame) -> int:
    """The set size up to which enumerating subsets moves fewer rows than scanning the lists of such sets."""
    few = posts.where(F.col("n") <= MOST_SMALL)
    scan = few.join(lists.select("tok", "entries"), "tok").groupBy("n").agg(F.sum("entries").alias("scan"))
    sets = few.groupBy("n").agg(F.countDistinct("doc").alias("sets"))
    cost = {r["n"]: (SUBSET_ROWS * r["sets"] * sum(math.comb(r["n"], c) for c in subset_sizes(r["n"])), PAIR_ROWS * (r["scan"] or 0)) for r in sets.join(scan, "n", "left").collect()}
    totals = {b: sum(x if n <= b else y for n, (x, y) in cost.items()) for b in range(MOST_SMALL + 1)}
    return min(totals, key=lambda b: (totals[b], b))


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each distinct row: component_id is the smallest id it reaches by links."""
    spark = docs.sparkSession
    small_batches(spark)
    sums = staged(_summaries(docs, key, text), "jaccard-sets")
    total, rows = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    same = sums.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    table, bits = class_table(docs.select(F.col(text)), lambda texts: shingle_sets(texts)[1], total)
    posts = staged(_posts(docs, key, text, table, bits), "jaccard-posts")
    # an id may hold several texts, so a set goes on under a hash of its own
    first = posts.join(same.where("rep is not null").select(F.col("rep").alias("doc"), "n", "h1", "h2"), ["doc", "n", "h1", "h2"], "left_semi").dropDuplicates(["doc", "n", "h1", "h2"])
    sets = staged(first.select(F.col("h1").alias("doc"), "n", "toks", "poss", "shingles"), "jaccard-reps")
    flat = sets.select("doc", "n", F.explode(F.arrays_zip("toks", "poss")).alias("p")).select("doc", "n", F.col("p.toks").alias("tok"), F.col("p.poss").alias("pos"))
    counts = flat.groupBy("tok").agg(F.count("*").alias("entries"), F.sum("n").alias("shingles_of")).where("entries > 1")
    flat = staged(flat.join(counts, "tok"), "jaccard-lists")
    lists = flat.groupBy("tok").agg(F.first("entries").alias("entries"), F.first("shingles_of").alias("shingles_of"))
    boundary = boundary_by_cost(flat.select("doc", "n", "tok"), lists)
    # pairs of two small sets come from subsets; a small set still meets the larger ones in the lists
    large = flat.where((F.col("n") > boundary) | (F.col("n") * 100 >= PERCENT * (boundary + 1)))
    light, heavy = large.where(F.col("entries") <= HEAVY), large.where(F.col("entries") > HEAVY)
    links = _pair_links(light, sets, "jaccard-pairs").union(_block_links(heavy, sets, lists.where(F.col("entries") > HEAVY)))
    if boundary:
        links = links.union(_subset_links(sets, boundary))
    found = components(staged(links.distinct(), "jaccard-links"), folder=shared_dir(spark))
    linked = staged(same.join(found, same["h1"] == found["vid"]).select("n", "h1", "h2", "rep", "component"), "jaccard-linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    ends = linked.join(least, "component").select("n", "h1", "h2", "component_id")
    reps = staged(same.join(ends, ["n", "h1", "h2"], "left").select("n", "h1", "h2", "copies", F.coalesce("component_id", "rep").alias("component_id")), "jaccard-ends")
    # rows without a set have nothing to meet; the fewer than COMMON sets that most rows share go to the rows, so no task gets a group of copies
    names, often = ["n", "h1", "h2"], F.col("copies") * COMMON > rows
    common, having = F.broadcast(reps.where(often).drop("copies")), sums.where("n > 0")
    out = having.join(common, names).select("doc", "n", "component_id")
    out = out.union(having.join(common, names, "left_anti").join(reps.where(~often), names).select("doc", "n", "component_id"))
    out = out.union(sums.where("n = 0").select("doc", "n", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")).distinct()
