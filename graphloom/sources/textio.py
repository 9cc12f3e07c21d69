"""Readers and writers of the text formats: edges, partitions, vertex data, configuration, results, logs."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import megabytes
from graphloom.operators.gcn import GcnConfig
from graphloom.operators.prep import implicit_vertices, undirected
from graphloom.plans.prepared import GraphError, PreparedGraph


def effective_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments (first character #)."""
    return spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").startswith("#"))


def _parts() -> Column:
    return F.split(F.trim("value"), r"\s+")


def read_edges(spark: SparkSession, path: str, default_weight: int = 1, both_ways: bool = False) -> DataFrame:
    """(src, dst, weight) of ``src dst [weight]`` lines; a bag, with the reverse edges too where asked for."""
    p = _parts()
    weight = F.when(F.size(p) > 2, F.get(p, F.lit(2)).cast("long")).otherwise(F.lit(default_weight))
    edges = effective_lines(spark, path).select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"), weight.cast("long").alias("weight"))
    return undirected(edges) if both_ways else edges


def read_partition(spark: SparkSession, path: str, tiles: int, merge_factor: int = 1) -> DataFrame:
    """(vid, tid) of ``vid tid`` lines; tiles merge by integer division. Raises GraphError on a tile out of range or an id twice."""
    p = _parts()
    parts = effective_lines(spark, path).select(p[0].cast("long").alias("vid"), F.floor(p[1].cast("long") / F.lit(merge_factor)).cast("long").alias("tid"))
    if row := parts.where((F.col("tid") >= tiles) | (F.col("tid") < 0)).first():
        raise GraphError(f"tile {row['tid']} of vertex {row['vid']} is out of range")
    if row := parts.groupBy("vid").count().where("count > 1").first():
        raise GraphError(f"vertex declared twice: {row['vid']}")
    return parts


def read_vertex_data(spark: SparkSession, path: str, width: int, known: DataFrame | None = None) -> DataFrame:
    """(vid, feature, label) of ``vid f1 .. fD label`` lines, of the ``known`` vertices only where given."""
    p = _parts()
    rows = effective_lines(spark, path).select(p[0].cast("long").alias("vid"), F.slice(p, 2, width).cast("array<double>").alias("feature"), F.element_at(p, width + 2).cast("int").alias("label"))
    return rows if known is None else rows.join(known.select("vid"), "vid", "left_semi")


def read_config(path: str) -> GcnConfig:
    """Settings of ``name : value`` lines. Reading stops at an unknown name, as the format asks; what came before holds."""
    kinds = {f.name: f.type for f in fields(GcnConfig)}
    found: dict[str, float | int] = {}
    with open(path) as f:
        for line in f:
            name, colon, value = (x.strip() for x in line.partition(":"))
            if not name and not colon:
                continue
            if name not in kinds:
                break
            found[name] = int(value) if kinds[name] == "int" else float(value)
    return GcnConfig(**found)


def read_graph(spark: SparkSession, edges: str, vertices: str | None = None, partition: str | None = None, tiles: int = 1, merge_factor: int = 1, width: int = 0, both_ways: bool = False, default_weight: int = 1) -> PreparedGraph:
    """A checked graph from its files. One tile needs no partition file: the edges' ends are the vertices then."""
    e = read_edges(spark, edges, default_weight, both_ways)
    parts = implicit_vertices(e) if tiles == 1 or partition is None else read_partition(spark, partition, tiles, merge_factor)
    if vertices is None:
        v = parts.select("vid", "tid", F.lit(None).cast("array<double>").alias("feature"), F.lit(None).cast("int").alias("label"))
    else:
        v = parts.join(read_vertex_data(spark, vertices, width, parts), "vid", "left").select("vid", "tid", "feature", "label")
    return PreparedGraph(v, e, tiles).check()


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)


def write_partition(parts: DataFrame, path: str) -> None:
    edges = parts.select(F.concat_ws("\t", F.col("vid").cast("string"), F.col("tid").cast("string")).alias("value"))
    edges.write.text(path)


def write_vertex_data(vertices: DataFrame, path: str) -> None:
    """Features with six decimals, then the label."""
    feats = F.concat_ws(" ", F.transform("feature", lambda x: F.format_string("%f", x)))
    vertices.select(F.concat_ws(" ", F.col("vid").cast("string"), feats, F.col("label").cast("string")).alias("value")).write.text(path)


def write_result(values: DataFrame, path: str, value: str) -> None:
    values.select(F.concat_ws("\t", F.col("vid").cast("string"), F.col(value).cast("string")).alias("value")).write.text(path)


def write_traffic(rows: DataFrame, path: str) -> None:
    """Lines ``party interface download upload``, in MB with two decimals, the largest download first by its number. ``rows`` has party, iface and the bytes down and up."""
    size = lambda c: F.coalesce(megabytes(F.col(c).cast("double")), F.lit("nullMB"))  # noqa: E731  concat_ws would drop a null and move its neighbour
    line = F.concat_ws(" ", F.col("party").cast("string"), "iface", size("down"), size("up"))
    rows.orderBy(F.desc("down"), "iface").select(line.alias("value")).write.text(path)


def read_log(spark: SparkSession, path: str, party: int) -> DataFrame:
    """(party, seq, value): the lines of one party's log in order. A log is one file of one process, read in one task."""
    return spark.read.text(path, wholetext=True).select(F.lit(party).alias("party"), F.posexplode(F.split("value", r"\r?\n")).alias("seq", "value"))
