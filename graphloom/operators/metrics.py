"""Splits and metrics per tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import vectors as V
from graphloom.plans.prepared import PreparedGraph


def reordered_index(g: PreparedGraph) -> DataFrame:
    """(vid, tid, idx, n): the place of a vertex in its tile by id, and the tile's size.

    A tile is one party's share, so the window is as large as a party; no window spans the graph.
    """
    tile = Window.partitionBy("tid")
    return g.parts.select("vid", "tid", (F.row_number().over(tile.orderBy("vid")) - 1).cast("long").alias("idx"), F.count("*").over(tile).alias("n"))


def split_of(idx: Column, n: Column, train: float = 0.2, val: float = 0.2) -> Column:
    first, second = F.floor(n * float(train)), F.floor(n * float(val))
    return F.when(idx < first, "train").when(idx < first + second, "val").otherwise("test")


def split_assign(g: PreparedGraph, train: float = 0.2, val: float = 0.2) -> DataFrame:
    """(vid, tid, split) by prefix cuts of each tile."""
    return reordered_index(g).select("vid", "tid", split_of(F.col("idx"), F.col("n"), train, val).alias("split"))


def masked_error(p: DataFrame, g: PreparedGraph, train: float = 0.2) -> DataFrame:
    """(vid, tid, h): softmax minus one-hot on training rows, zero vectors elsewhere. ``p`` has vid, p."""
    rank = reordered_index(g).select("vid", (F.col("idx") < F.floor(F.col("n") * float(train))).alias("on"))
    rows = p.join(g.vertices.select("vid", "tid", "label"), "vid").join(rank, "vid")
    error = F.zip_with("p", F.sequence(F.lit(0), F.size("p") - 1), lambda x, j: F.when(F.col("on"), x - (j == F.col("label")).cast("double")).otherwise(F.lit(0.0)))
    return rows.select("vid", "tid", error.alias("h"))


def cross_entropy(p: DataFrame, g: PreparedGraph, clamp: float = 0.001) -> DataFrame:
    """(tid, loss): mean of -ln of the label's probability; a probability of 0 reads as ``clamp``."""
    rows = p.join(g.vertices.select("vid", "tid", "label"), "vid").withColumn("q", F.col("p")[F.col("label")])
    return rows.groupBy("tid").agg(F.avg(-F.log(F.when(F.col("q") == 0, F.lit(clamp)).otherwise(F.col("q")))).alias("loss"))


def accuracy_by_split(p: DataFrame, g: PreparedGraph, train: float = 0.2, val: float = 0.2) -> DataFrame:
    """(tid, metric, value): percent of right predictions on full, train, test and their border parts, and the counts."""
    hit = (V.argmax(F.col("p")) == F.col("label")).cast("double") * 100
    rows = p.join(g.vertices.select("vid", "tid", "label"), "vid").join(split_assign(g, train, val).select("vid", "split"), "vid").join(g.border, "vid").withColumn("hit", hit)
    groups = {"full": F.lit(True), "train": F.col("split") == "train", "border_train": (F.col("split") == "train") & F.col("is_border"), "test": F.col("split") == "test", "border_test": (F.col("split") == "test") & F.col("is_border")}
    aggs = [F.avg(F.when(c, F.col("hit"))).alias(k) for k, c in groups.items()]
    wide = rows.groupBy("tid").agg(*aggs, F.count("*").cast("double").alias("vertices"), F.count_if("is_border").cast("double").alias("border"))
    names = [*groups, "vertices", "border"]
    return wide.select("tid", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in names])).alias("x")).select("tid", "x.metric", "x.value")
