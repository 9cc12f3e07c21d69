"""Data preparation: tiles, block partitions, growing subsets, edge filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.prepared import PreparedGraph
from graphloom.plans.staging import staged


def round_robin(vertices: DataFrame, tiles: int) -> DataFrame:
    return vertices.select("vid", F.pmod("vid", F.lit(tiles)).cast("long").alias("tid"))


def blocks(vertices: DataFrame, parts: int) -> DataFrame:
    """(vid, part): contiguous blocks by id; the first n % parts blocks hold one more.

    Ids are ranked range by range: a range's offset plus the rank inside it, so no window spans all rows.
    The ranges are written down once, as sampling them again could draw others.
    """
    ids = staged(vertices.select("vid").repartitionByRange("vid").withColumn("__r", F.spark_partition_id()), "ranges")
    ids = ids.select("vid", "__r", (F.row_number().over(Window.partitionBy("__r").orderBy("vid")) - 1).alias("__i"))
    sizes = ids.groupBy("__r").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__o"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__total"))
    at = F.col("__i") + F.col("__o")
    small, more = F.floor(F.col("__total") / parts), F.col("__total") % parts
    edge = (small + 1) * more
    part = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    return ids.join(F.broadcast(offsets), "__r").select("vid", part.cast("long").alias("part"))  # one row for each range


def inside(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends are in the set."""
    src, dst = vertices.select(F.col("vid").alias("src")), vertices.select(F.col("vid").alias("dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(edges.columns)


def prefix_subset(g: PreparedGraph, parts: int, upto: int) -> PreparedGraph:
    """The graph of the first ``upto`` + 1 of ``parts`` blocks, with the block as tile."""
    member = blocks(g.vertices, parts).where(F.col("part") <= upto)
    vertices = g.vertices.drop("tid").join(member.withColumnRenamed("part", "tid"), "vid").select("vid", "tid", "feature", "label")
    return PreparedGraph(vertices, inside(g.edges, member), upto + 1)


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` with ``part``, the key's remainder by ``parts``, and its rows dealt by it."""
    return df.withColumn("part", F.pmod(key, F.lit(parts)).cast("long")).repartition(parts, "part")


def undirected(edges: DataFrame) -> DataFrame:
    """The bag with every edge's reverse."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def missing_reverse(edges: DataFrame) -> DataFrame:
    """Distinct edges whose reverse is not there; empty for an undirected graph."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def implicit_vertices(edges: DataFrame) -> DataFrame:
    """(vid, tid 0): every edge end once, for graphs without a partition file."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct().select("vid", F.lit(0).cast("long").alias("tid"))


def in_lists(edges: DataFrame) -> DataFrame:
    """(vid, sources): in-adjacency lists in order; for graphs whose in-degrees fit a row."""
    return edges.groupBy(F.col("dst").alias("vid")).agg(F.sort_array(F.collect_list("src")).alias("sources"))
