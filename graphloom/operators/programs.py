"""Vertex programs: PageRank, shortest paths with parents, breadth-first levels, components, pair sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import safe_divide
from graphloom.operators.messages import VertexProgram, run_rounds
from graphloom.plans.components import components
from graphloom.plans.prepared import PreparedGraph
from graphloom.plans.staging import shared_dir, staged


def pagerank(g: PreparedGraph, rounds: int = 5, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(vid, rank). Ranks start equal; a vertex without out-edges sends nothing."""
    n = g.vertices.count()
    state = g.out_degree.select("vid", F.col("out_degree").cast("double").alias("out"), F.lit(1.0 / n if n else 0.0).alias("rank"))
    program = VertexProgram(
        message=lambda: safe_divide(F.col("rank"), F.col("out")),
        combine=F.sum,
        apply=lambda: {"rank": F.lit((1 - damping) / n if n else 0.0) + F.lit(damping) * F.coalesce("msg", F.lit(0.0))},
    )
    settled = None
    if tolerance is not None:
        settled = lambda a, b: (a.select("vid", F.col("rank").alias("r")).join(b, "vid").agg(F.max(F.abs(F.col("rank") - F.col("r")))).first()[0] or 0.0) <= tolerance
    return run_rounds(g, state, program, rounds, cut=lambda df: staged(df, "pagerank"), until=settled).select("vid", "rank")


def shortest_paths(g: PreparedGraph, source: int, rounds: int) -> DataFrame:
    """(vid, dist, parent) after paths of at most ``rounds`` edges; null where none leads. Ties go to the smaller parent."""
    state = g.vertices.select("vid", F.when(F.col("vid") == source, F.lit(0)).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent"))
    better = F.col("msg").isNotNull() & (F.col("dist").isNull() | (F.col("msg.dist") < F.col("dist")))
    program = VertexProgram(
        message=lambda: F.when(F.col("dist").isNotNull(), F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("parent"))),
        combine=F.min,
        apply=lambda: {"dist": F.when(better, F.col("msg.dist")).otherwise(F.col("dist")), "parent": F.when(better, F.col("msg.parent")).otherwise(F.col("parent"))},
    )
    return run_rounds(g, state, program, rounds, cut=lambda df: staged(df, "paths"))


def bfs_levels(g: PreparedGraph, source: int, rounds: int) -> DataFrame:
    """(vid, level): hops from the source, null beyond ``rounds``."""
    hops = PreparedGraph(g.vertices, g.edges.withColumn("weight", F.lit(1).cast("long")), g.tiles)
    return shortest_paths(hops, source, rounds).select("vid", F.col("dist").alias("level"))


def connected_components(g: PreparedGraph) -> DataFrame:
    """(vid, component) of every vertex; isolated ones are their own."""
    found = components(g.edges, folder=shared_dir(g.vertices.sparkSession))
    return g.vertices.select("vid").join(found, "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))


def pair_sums(g: PreparedGraph, value: str = "x") -> DataFrame:
    """(vid, total, count): the componentwise sum of (value, 1) pairs over in-edges; ``vertices`` hold ``value``."""
    sent = g.edges.join(g.vertices.select(F.col("vid").alias("src"), F.col(value).alias("x")), "src")
    return sent.groupBy(F.col("dst").alias("vid")).agg(F.sum("x").alias("total"), F.count("*").alias("count"))
