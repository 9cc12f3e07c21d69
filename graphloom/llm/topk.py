"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers, packed into blocks of about BLOCK rows, and every block holds, for
each dimension, its rows in order of that component, sorted once. A query goes down all lists of a block
at once, scores what it meets exactly, and stops when the best score that any unseen row can have is
below its k-th result. The first block tells each query a k-th score that its result cannot fall under;
the other blocks start from that bound. Where most rows of a block are met, the others are scored too, as
that takes less than the lists. Queries come in blocks too, so that a block pair is one bounded unit of
work that any executor can redo; the winners of the pairs are merged per query.

Defined results: vectors that are null or empty, or that hold null or non-finite components, take no
part; vectors meet only vectors of equal length; ties go to the smaller id; rows repeated in id and
vector count once; a row is never a result of a query of its own id; an empty table has no results; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import staged

#: Rows of a packed block, and queries of one.
BLOCK, QUERY_BLOCK = 8192, 2048
#: First depth of a round of sorted access; each round goes DEEPER times as deep.
DEPTH, DEEPER = 16, 2


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """(dimension, place): the rows of each dimension from its smallest component to its largest."""
    return np.argsort(rows, axis=0, kind="stable").T.astype(np.int32, order="C")


def threshold_search(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of a block for a query, of those that reach ``floor``, and how many rows were scored. Scores are exact: the integers stay below 2**53."""
    n, dims = rows.shape
    seen = np.zeros(n, bool)
    best_s, best_i = np.empty(0), np.empty(0, np.int64)
    depth, done = DEPTH, 0
    every = np.arange(dims)
    used = query != 0
    while True:
        upto = n if 2 * seen.sum() > n else min(depth, n)
        met = np.zeros(n, bool)
        up, down = used & (query > 0), used & (query < 0)
        met[lists[up, n - upto : n - done].ravel()] = True
        met[lists[down, done:upto].ravel()] = True
        if not used.any():
            met[:] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        fresh = new[ids[new] != own]
        s = np.concatenate([best_s, rows[fresh] @ query])
        i = np.concatenate([best_i, ids[fresh]])
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s >= cut)
            keep = keep[np.lexsort((i[keep], -s[keep]))[:k]]
            s, i = s[keep], i[keep]
        best_s, best_i = s, i
        if upto == n or not used.any():
            break
        edge = np.where(query > 0, lists[:, n - upto], lists[:, upto - 1])
        # rows not met yet score at most this; an equal score could still win by its id
        bar = max(floor, best_s.min()) if len(best_s) == k else floor
        if bar > float(rows[edge, every] @ query):
            break
        done, depth = upto, depth * DEEPER
    order = np.lexsort((best_i, -best_s))
    return [(int(best_s[j]), int(best_i[j])) for j in order if best_s[j] >= floor], int(seen.sum())


def _packed(df: DataFrame, blocks: int, name: str, with_lists: bool = False) -> DataFrame:
    """One row per block: dims, ids, rows, sorted lists and bounds as packed arrays."""

    def pack(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("__id").to_numpy(), "<i8")
        flat = t.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        dims = len(flat) // len(ids)
        lists = sorted_lists(flat.reshape(-1, dims)).astype("<i4").tobytes() if with_lists else b""
        floors = t.column("__floor").to_numpy().astype("<f8").tobytes()
        packed = {"_ids": ids.tobytes(), "_rows": flat.tobytes(), "_lists": lists, "_floors": floors}
        return pa.table({name: pa.array([t.column(name)[0].as_py()], pa.int64()), "__dims": pa.array([dims], pa.int32()), **{name + k: pa.array([x], pa.binary()) for k, x in packed.items()}})

    block = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(blocks)).cast("long")
    return df.withColumn(name, block).withColumn("__dims", F.size("__v")).groupBy(name, "__dims").applyInArrow(pack, f"{name} long, __dims int, {name}_ids binary, {name}_rows binary, {name}_lists binary, {name}_floors binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k best other rows by inner product."""
    base = vectors.select(F.col(key).cast("long").alias("__id"), quantised(F.col(vector), scale).alias("__v"), queries.alias("__q")).where("__v is not null and __id is not null").distinct()
    base = staged(base, "topk-vectors")
    n = base.agg(F.count("*").alias("n"), F.count_if("__q").alias("q")).first()
    row_blocks, query_blocks = -(-n["n"] // BLOCK) or 1, -(-n["q"] // QUERY_BLOCK) or 1
    no_floor = F.lit(float("-inf")).alias("__floor")
    blocks = staged(_packed(base.select("__id", "__v", no_floor), row_blocks, "__rb", with_lists=True), "topk-blocks")
    asked = base.where("__q").select("__id", "__v")
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, ids, flat, packed, qids, qflat, floors in b.itertuples(index=False):
                own, r = np.frombuffer(ids, "<i8"), np.frombuffer(flat, "<f8").reshape(-1, dims)
                lists = np.frombuffer(packed, "<i4").reshape(dims, -1)
                found = []
                for q, v, floor in zip(np.frombuffer(qids, "<i8"), np.frombuffer(qflat, "<f8").reshape(-1, dims), np.frombuffer(floors, "<f8")):
                    found += [(int(q), i, s) for s, i in threshold_search(v, q, own, r, lists, k, floor)[0]]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def met(rows: DataFrame, queries: DataFrame, count: int) -> DataFrame:
        pairs = rows.withColumn("__qb", dealt).join(_packed(queries, query_blocks, "__qb"), ["__qb", "__dims"])
        pairs = pairs.select("__dims", "__rb_ids", "__rb_rows", "__rb_lists", "__qb_ids", "__qb_rows", "__qb_floors")
        # a pair is heavy: deal pairs out one by one instead of by the bytes they take
        pairs = pairs.repartition(max(1, min(2000, count * query_blocks)), F.xxhash64("__rb_ids", "__qb_ids"))
        return pairs.mapInPandas(search, "query_id long, vec_id long, score long")

    local = staged(met(blocks.where("__rb = 0"), asked.select("*", no_floor), 1), "topk-first")
    if row_blocks > 1:
        floors = local.groupBy("query_id").agg(F.min("score").cast("double").alias("__least"), F.count("*").alias("__n")).where(F.col("__n") == k)
        known = asked.join(floors, F.col("__id") == F.col("query_id"), "left").select("__id", "__v", F.coalesce("__least", no_floor).alias("__floor"))
        local = local.union(met(blocks.where("__rb > 0"), known, row_blocks - 1))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
