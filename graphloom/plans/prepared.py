"""The prepared property graph: vertices, edges and tiles, with the bookkeeping that programs reuse."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GraphError(ValueError):
    """A graph whose tables contradict each other."""


@dataclass
class PreparedGraph:
    """``vertices`` (vid, tid, feature, label) and ``edges`` (src, dst, weight), a bag of directed edges.

    Everything else is derived lazily; nothing is collected. Edges belong to the tile of their source.
    """

    vertices: DataFrame
    edges: DataFrame
    tiles: int = 1
    _notes: dict = field(default_factory=dict)

    @cached_property
    def parts(self) -> DataFrame:
        return self.vertices.select("vid", "tid")

    @cached_property
    def tiled_edges(self) -> DataFrame:
        """Edges with the tiles of both ends."""
        src = self.parts.select(F.col("vid").alias("src"), F.col("tid").alias("src_tid"))
        dst = self.parts.select(F.col("vid").alias("dst"), F.col("tid").alias("dst_tid"))
        return self.edges.join(src, "src").join(dst, "dst").select("src", "dst", "weight", "src_tid", "dst_tid")

    def _degree(self, end: str, name: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(end).alias("vid")).agg(F.count("*").alias(name))
        return self.vertices.select("vid").join(counts, "vid", "left").select("vid", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    @cached_property
    def in_degree(self) -> DataFrame:
        return self._degree("dst", "in_degree")

    @cached_property
    def out_degree(self) -> DataFrame:
        return self._degree("src", "out_degree")

    @cached_property
    def degree_edges(self) -> DataFrame:
        """(src, dst, src_out, dst_in): every edge with its source's out-degree and its destination's in-degree."""
        src = self.out_degree.select(F.col("vid").alias("src"), F.col("out_degree").alias("src_out"))
        dst = self.in_degree.select(F.col("vid").alias("dst"), F.col("in_degree").alias("dst_in"))
        return self.edges.join(src, "src").join(dst, "dst").select("src", "dst", "src_out", "dst_in")

    @cached_property
    def scale(self) -> DataFrame:
        """(vid, s): one over the root of in-degree + 1."""
        return self.in_degree.select("vid", F.pow(F.col("in_degree") + 1, F.lit(-0.5)).alias("s"))

    @cached_property
    def border(self) -> DataFrame:
        """(vid, is_border): whether an outgoing edge leaves the vertex's tile."""
        out = self.tiled_edges.groupBy(F.col("src").alias("vid")).agg(F.bool_or(F.col("src_tid") != F.col("dst_tid")).alias("is_border"))
        return self.vertices.select("vid").join(out, "vid", "left").select("vid", F.coalesce("is_border", F.lit(False)).alias("is_border"))

    @cached_property
    def mirrors(self) -> DataFrame:
        """(tid, vid, owner): the distinct remote destinations of each tile."""
        far = self.tiled_edges.where("src_tid <> dst_tid")
        return far.select(F.col("src_tid").alias("tid"), F.col("dst").alias("vid"), F.col("dst_tid").alias("owner")).distinct()

    def check(self) -> PreparedGraph:
        """Raises GraphError for a vertex declared twice or an edge end that is no vertex."""
        twice = self.vertices.groupBy("vid").count().where("count > 1").limit(1)
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("vid")).join(self.parts, "vid", "left_anti").limit(1)
        for df, what in ((twice, "vertex declared twice"), (ends, "edge end without a vertex")):
            if row := df.first():
                raise GraphError(f"{what}: {row['vid']}")
        return self

    def cache(self) -> PreparedGraph:
        """Keeps vertices and edges, for programs of many rounds."""
        self.vertices, self.edges = self.vertices.cache(), self.edges.cache()
        return self

    def save(self, path: str) -> None:
        """Writes the preparation, with what was derived of it, for runs that resume from it."""
        whole = self.vertices.join(self.in_degree, "vid").join(self.out_degree, "vid").join(self.border, "vid")
        whole.withColumn("tiles", F.lit(self.tiles)).write.parquet(f"{path}/vertices")
        self.edges.write.parquet(f"{path}/edges")
        self.mirrors.write.parquet(f"{path}/mirrors")


def load(spark: SparkSession, path: str) -> PreparedGraph:
    """The graph that ``save`` wrote: degrees, border and mirrors are read, not computed again."""
    whole = spark.read.parquet(f"{path}/vertices")
    first = whole.select("tiles").first()
    derived = ("in_degree", "out_degree", "is_border", "tiles")
    g = PreparedGraph(whole.drop(*derived), spark.read.parquet(f"{path}/edges"), first["tiles"] if first else 1)
    g.in_degree, g.out_degree, g.border = (whole.select("vid", c) for c in derived[:3])
    g.mirrors = spark.read.parquet(f"{path}/mirrors")
    return g


def from_tables(spark: SparkSession, sf_dir: str, tiles: int = 3) -> PreparedGraph:
    """The canonical graph of the driver's tables: embeddings as vertices, customers and parts of large line items as symmetric edges."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = emb.count()
    vertices = emb.select(F.col("vec_id").alias("vid"), F.pmod("vec_id", F.lit(tiles)).cast("long").alias("tid"), F.col("embedding").cast("array<double>").alias("feature"), "label")
    base = base_edges(spark, sf_dir, n)
    both = base.union(base.select("dst", "src"))
    edges = both.where("src <> dst").distinct().withColumn("weight", F.lit(1).cast("long"))
    return PreparedGraph(vertices, edges, tiles)


def base_edges(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The directed bag that the canonical edges come from: duplicates and loops kept."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 47").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.pmod("o_custkey", F.lit(n)).alias("src"), F.pmod("l_partkey", F.lit(n)).alias("dst"))
