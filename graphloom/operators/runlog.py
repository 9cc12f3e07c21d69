"""Analytics of run logs: durations, traffic, stage shares, cost models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the published settings: dataset, vertices, edges, features, labels, hidden width.
DATASETS = [("cora", 2708, 10556, 1433, 7, 16), ("citeseer", 3312, 10016, 3703, 6, 16), ("pubmed", 19717, 128146, 500, 3, 16)]


def parse_durations(lines: DataFrame) -> DataFrame:
    """(party, seq, tag, seconds) of ``::tag took x seconds`` lines; where the number was torn off, the next line that says seconds has it.

    ``lines`` has party, seq, value.
    """
    tag = F.regexp_extract("value", r"::(\S+) took", 1)
    secs = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?) seconds", 1)
    rows = lines.select("party", "seq", tag.alias("tag"), F.when(secs != "", secs.cast("double")).alias("seconds"))
    # read backwards, what comes later is what came before: a running window, one step a line
    later = Window.partitionBy("party").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seconds", F.last("seconds", ignorenulls=True).over(later)).where(F.col("tag") != "")


def parse_metrics(lines: DataFrame) -> DataFrame:
    """(party, seq, metric, value) of ``name = number`` lines."""
    rows = lines.select("party", "seq", F.regexp_extract("value", r"^\s*([\w -]+?)\s*=\s*([-0-9.]+)", 1).alias("metric"), F.regexp_extract("value", r"^\s*([\w -]+?)\s*=\s*([-0-9.]+)", 2).alias("value"))
    return rows.where("metric <> ''").withColumn("value", F.col("value").cast("double"))


def parse_accuracy(lines: DataFrame) -> DataFrame:
    """(part, test_acc, border_acc), in percent, of ``[Part: i] ... Test accuracy: x% ... Test is_border accuracy: y%`` lines."""
    found = lambda pattern: F.regexp_extract("value", pattern, 1)
    rows = lines.select(found(r"\[Part: (\d+)\]").alias("part"), found(r"Test accuracy: ([0-9.]+)%").alias("test_acc"), found(r"Test is_border accuracy: ([0-9.]+)%").alias("border_acc"))
    return rows.where("part <> '' and test_acc <> ''").select(F.col("part").cast("int").alias("part"), F.col("test_acc").cast("double").alias("test_acc"), F.when(F.col("border_acc") != "", F.col("border_acc")).cast("double").alias("border_acc"))


def party_accuracy(rows: DataFrame) -> DataFrame:
    """(part, runs, test_acc, border_acc): the means of each party."""
    return rows.groupBy("part").agg(F.count("*").alias("runs"), F.avg("test_acc").alias("test_acc"), F.avg("border_acc").alias("border_acc"))


def epoch_accuracy(lines: DataFrame) -> DataFrame:
    """(epoch, lines, test_acc, best): the mean over the parties of each epoch, and the best mean up to it."""
    number = lambda pattern: F.regexp_extract("value", pattern, 1)
    rows = lines.select(number(r"Epoch: (\d+)").alias("epoch"), number(r"Test accuracy: ([0-9.]+)%").alias("test_acc")).where("epoch <> '' and test_acc <> ''")
    means = rows.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count("*").alias("lines"), F.avg(F.col("test_acc").cast("double")).alias("test_acc"))
    return means.withColumn("best", F.max("test_acc").over(Window.partitionBy(F.lit(0)).orderBy("epoch")))  # one row for each epoch


def first_matches(lines: DataFrame, pattern: str, n: int) -> DataFrame:
    """(party, place, seq, value): the first ``n`` lines of each party that match. ``lines`` has party, seq, value."""
    place = F.row_number().over(Window.partitionBy("party").orderBy("seq")).cast("long")
    return lines.where(F.col("value").rlike(pattern)).withColumn("place", place).where(F.col("place") <= n).select("party", "place", "seq", "value")


def parse_traffic(lines: DataFrame) -> DataFrame:
    """(iface, download_mb, upload_mb) of the virtual interfaces in a traffic table, largest download first."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[1].alias("iface"), F.regexp_replace(parts[2], "MB$", "").try_cast("double").alias("download_mb"), F.regexp_replace(parts[3], "MB$", "").try_cast("double").alias("upload_mb"))
    return rows.where("iface like 'veth%' and download_mb is not null").orderBy(F.desc("download_mb"))


def epoch_durations(iterations: DataFrame, per_epoch: int) -> DataFrame:
    """(party, epoch, seconds): sums of each ``per_epoch`` consecutive iterations. ``iterations`` has party, iter, seconds."""
    return iterations.groupBy("party", F.floor(F.col("iter") / per_epoch).cast("long").alias("epoch")).agg(F.sum("seconds").alias("seconds"))


def party_mean(epochs: DataFrame) -> DataFrame:
    """(epoch, seconds): the mean over the parties."""
    return epochs.groupBy("epoch").agg(F.avg("seconds").alias("seconds"))


def stage_breakdown(rows: DataFrame, epochs: Column | float) -> DataFrame:
    """(tag, seconds, share): seconds for an epoch by tag, and the tag's share of all."""
    per = rows.groupBy("tag").agg((F.sum("seconds") / epochs).alias("seconds"))
    return per.select("tag", "seconds", (F.col("seconds") / F.sum("seconds").over(Window.partitionBy(F.lit(0)))).alias("share"))  # one row for each tag


def online_split(rows: DataFrame, epochs: float) -> DataFrame:
    """(party, preprocess, online): with minus without preprocessing, and without, for an epoch. ``rows`` has party, with_prep, seconds."""
    per = rows.groupBy("party").agg(F.sum(F.when(F.col("with_prep"), F.col("seconds")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("with_prep"), F.col("seconds")).otherwise(0.0)).alias("b"))
    return per.select("party", ((F.col("a") - F.col("b")) / epochs).alias("preprocess"), (F.col("b") / epochs).alias("online"))


def speedups(rows: DataFrame) -> DataFrame:
    """(parties, speedup, growth): slow over fast, and fast over its first value by number of parties. ``rows`` has parties, slow, fast."""
    w = Window.partitionBy(F.lit(0)).orderBy("parties").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("parties", (F.col("slow") / F.col("fast")).alias("speedup"), (F.col("fast") / F.first("fast").over(w)).alias("growth"))


def traffic_per_party(rows: DataFrame, parties: int, epochs: int) -> DataFrame:
    """(gb): traffic of a party in an epoch, from MB down and up."""
    return rows.agg((F.sum(F.col("download_mb") + F.col("upload_mb")) / parties / epochs / 1024).alias("gb"))


def cost_models(spark: SparkSession) -> DataFrame:
    """(dataset, model, gb): message-passing volume of five designs, from graph sizes and widths."""
    d = spark.createDataFrame(DATASETS, "dataset string, n long, e long, d long, c long, h long")
    m, m_opt = 8 * (F.col("d") + 2 * F.col("h")), 8 * (3 * F.col("h") + 2 * F.col("c"))
    n, e = F.col("n"), F.col("e")
    models = {"adjacency_matrix": 2 * m * (n * n + n), "adjacency_list": m * n * e, "graphsc": 10 * m * (n + e), "original": m * (n + 5 * e), "optimized": m_opt * (n + 5 * e)}
    rows = F.array(*[F.struct(F.lit(k).alias("model"), (v / F.lit(float(1 << 30))).alias("gb")) for k, v in models.items()])
    return d.select("dataset", F.explode(rows).alias("x")).select("dataset", "x.model", "x.gb")


def inter_edge_ratio(edges: DataFrame, tiles: list[int]) -> DataFrame:
    """(tiles, ratio): share of edges between tiles under vid % tiles, for several numbers of tiles in one pass."""
    aggs = [F.avg((F.pmod("src", F.lit(t)) != F.pmod("dst", F.lit(t))).cast("double")).alias(str(t)) for t in tiles]
    one = edges.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("tiles"), F.col(str(t)).alias("ratio")) for t in tiles])).alias("x")).select("x.tiles", "x.ratio")
