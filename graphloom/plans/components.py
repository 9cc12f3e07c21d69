"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame, folder: str | None) -> DataFrame:
    """Cuts the lineage: a table in ``folder``, or a reliable checkpoint where none is given."""
    if folder is None:
        return df.checkpoint()
    path = f"{folder}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", folder: str | None = None, max_rounds: int = 60) -> DataFrame:
    """(vid, component) for every vertex of ``edges``: the smallest vertex id that it reaches.

    Each round re-hangs the neighbours of a vertex onto its smallest neighbour, so a component of any
    shape becomes a star in a logarithmic number of rounds; no group is ever gathered into one row.
    Loops are ignored as links but keep their vertex; an empty table has no components.
    """
    own = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    e = own.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = _cut(e, folder)
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        e = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = _cut(e, folder)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    alone = own.select(F.col("u").alias("vid")).union(own.select("v")).distinct()
    return alone.join(e.withColumnRenamed("u", "vid"), "vid", "left").select("vid", F.coalesce("v", "vid").alias("component"))
