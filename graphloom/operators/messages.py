"""Message passing as joins and sums: gather-apply-scatter over vector-valued vertices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import vectors as V
from graphloom.plans.prepared import PreparedGraph


def propagate(g: PreparedGraph, h: DataFrame, width: int, pre: bool = True, post: bool = True) -> DataFrame:
    """S (A + I) S h over (vid, h): scale, send along edges, add the own row, sum, scale.

    The scale rides on the vertex's own row, so one join of the edges and one aggregation is all.
    """
    own = h.select("vid", "h").join(g.scale, "vid")
    if pre:
        own = own.withColumn("h", V.scaled(F.col("h"), F.col("s")))
    sent = g.edges.select("src", F.col("dst").alias("vid")).join(own.select(F.col("vid").alias("src"), "h"), "src")
    every = sent.select("vid", F.lit(None).cast("double").alias("s"), "h").union(own.select("vid", "s", "h"))
    out = V.sum_vectors(every, ["vid"], "h", width, [F.max("s").alias("s")])
    return out.select("vid", (V.scaled(F.col("h"), F.col("s")) if post else F.col("h")).alias("h"))


def propagate_per_edge(g: PreparedGraph, h: DataFrame, width: int, forward: bool = True) -> DataFrame:
    """The unoptimised rule: each edge's message is scaled by both ends, the own row once (forward) or not at all."""
    s = g.scale
    ends = g.edges.select("src", "dst").join(s.select(F.col("vid").alias("src"), F.col("s").alias("s0")), "src").join(s.select(F.col("vid").alias("dst"), F.col("s").alias("s1")), "dst")
    sent = ends.join(h.select(F.col("vid").alias("src"), "h"), "src").select(F.col("dst").alias("vid"), V.scaled(V.scaled(F.col("h"), F.col("s0")), F.col("s1")).alias("h"))
    own = h.join(s, "vid").select("vid", (V.scaled(F.col("h"), F.col("s")) if forward else F.col("h")).alias("h"))
    return V.sum_vectors(sent.union(own), ["vid"], "h", width)


def source_values(g: PreparedGraph, h: DataFrame) -> DataFrame:
    """Vertex values mapped to edge sources, inside and between tiles: (src, dst, inter, h)."""
    e = g.tiled_edges.select("src", "dst", (F.col("src_tid") != F.col("dst_tid")).alias("inter"))
    return e.join(h.select(F.col("vid").alias("src"), "h"), "src")


def premerged(g: PreparedGraph, h: DataFrame, width: int) -> DataFrame:
    """Updates summed per sending tile and destination: (tid, vid, h)."""
    sent = g.tiled_edges.select(F.col("src_tid").alias("tid"), F.col("dst").alias("vid"), "src").join(h.select(F.col("vid").alias("src"), "h"), "src")
    return V.sum_vectors(sent, ["tid", "vid"], "h", width)


def gathered(g: PreparedGraph, h: DataFrame, updates: DataFrame, tid: int) -> DataFrame:
    """Each vertex's value plus the update from tile ``tid`` where one came; others stay as they are."""
    up = updates.where(F.col("tid") == tid).select("vid", F.col("h").alias("u"))
    return h.join(up, "vid", "left").select("vid", V.added_where(F.col("h"), F.col("u"), F.col("u").isNotNull()).alias("h"))


def bumped_degrees(g: PreparedGraph) -> DataFrame:
    """(vid, in_degree): one more for a vertex without an in-edge from its own tile."""
    inside = g.tiled_edges.where("src_tid = dst_tid").select(F.col("dst").alias("vid")).distinct().withColumn("has", F.lit(True))
    return g.in_degree.join(inside, "vid", "left").select("vid", (F.col("in_degree") + F.when(F.col("has").isNull(), 1).otherwise(0)).alias("in_degree"))


def with_bumped_degrees(g: PreparedGraph) -> PreparedGraph:
    """The graph with ``bumped_degrees`` in place of its in-degrees, so that every scale derived of them follows."""
    out = PreparedGraph(g.vertices, g.edges, g.tiles)
    out.in_degree = bumped_degrees(g)
    return out


@dataclass(frozen=True)
class VertexProgram:
    """A scalar program: a message per edge, an aggregate per destination, and the new state.

    ``message`` sees the source's state and the edge; ``combine`` folds the messages into ``msg``;
    ``apply`` sees the old state and ``msg`` (null where nothing came).
    """

    message: Callable[[], Column]
    combine: Callable[[Column], Column]
    apply: Callable[[], dict[str, Column]]


def run_rounds(g: PreparedGraph, state: DataFrame, program: VertexProgram, rounds: int, cut: Callable[[DataFrame], DataFrame] | None = None, every: int = 1, until: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """Runs ``rounds`` rounds, or fewer once ``until`` holds; ``cut`` writes the state out every few rounds.

    A round reads the state twice, so an uncut plan doubles with each round.
    """
    columns = state.columns
    for i in range(rounds):
        sent = g.edges.join(state.withColumnRenamed("vid", "src"), "src").select(F.col("dst").alias("vid"), program.message().alias("m"))
        got = sent.groupBy("vid").agg(program.combine(F.col("m")).alias("msg"))
        new = program.apply()
        nxt = state.join(got, "vid", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])
        if cut is not None and (i + 1) % every == 0:
            nxt = cut(nxt)
        if until is not None and until(state, nxt):
            return nxt
        state = nxt
    return state


@dataclass(frozen=True)
class VectorProgram:
    """The stages of a round over array-valued vertices; each is an expression.

    ``pre_scatter`` sees the vertex's h and in_degree; ``scatter`` what was made of it, as h, and the
    edge; messages add up component by component, with ``pre_merge`` in each sending tile first;
    ``gather`` sees the vertex's h and ``msg`` (null where nothing came); ``apply`` the gathered h and in_degree.
    """

    pre_scatter: Callable[[], Column] = lambda: F.col("h")
    scatter: Callable[[], Column] = lambda: F.col("h")
    gather: Callable[[], Column] = lambda: V.added_where(F.col("h"), F.col("msg"), F.col("msg").isNotNull())
    apply: Callable[[], Column] = lambda: F.col("h")
    pre_merge: bool = False


def run_vector_rounds(g: PreparedGraph, h: DataFrame, width: int, program: VectorProgram, rounds: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(vid, h) after ``rounds`` rounds of a program over (vid, h) of ``width`` components."""
    edges = g.tiled_edges if program.pre_merge else g.edges
    for _ in range(rounds):
        own = h.join(g.in_degree, "vid")
        out = own.select(F.col("vid").alias("src"), program.pre_scatter().alias("h"))
        tile = [F.col("src_tid").alias("tid")] if program.pre_merge else []
        sent = edges.join(out, "src").select(F.col("dst").alias("vid"), *tile, program.scatter().alias("h"))
        if program.pre_merge:
            sent = V.sum_vectors(sent, ["tid", "vid"], "h", width)
        got = V.sum_vectors(sent, ["vid"], "h", width).select("vid", F.col("h").alias("msg"))
        met = own.join(got, "vid", "left").select("vid", "in_degree", program.gather().alias("h"))
        h = met.select("vid", program.apply().alias("h"))
        if cut is not None:
            h = cut(h)
    return h
