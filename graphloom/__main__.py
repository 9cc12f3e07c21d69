"""Command line: trains or applies a graph convolution on text files, or runs a vertex program."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import gcn, messages, metrics, programs
from graphloom.plans.prepared import PreparedGraph, load
from graphloom.sources import textio


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("program", choices=["train", "infer", "pagerank", "paths", "components"])
    p.add_argument("edges")
    p.add_argument("vertices", nargs="?")
    p.add_argument("partition", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("config", nargs="?")
    p.add_argument("-g", "--tiles", type=int, default=1)
    p.add_argument("-f", "--merge-factor", type=int, default=1)
    p.add_argument("-m", "--max-iters", type=int, default=1000)
    p.add_argument("-u", "--undirected", action="store_true")
    p.add_argument("-s", "--source", type=int, default=0)
    p.add_argument("-k", "--kernel", choices=["optimized", "original", "delayed"], default="optimized")
    p.add_argument("-r", "--bump-degrees", action="store_true", help="one more in-edge for vertices without one from their own tile")
    p.add_argument("-n", "--prepared", help="folder of a stored preparation: read if it is there, else written")
    p.add_argument("--log", help="Parquet table for the metrics of each epoch")
    p.add_argument("--grad", choices=["full", "optimized"], default="full")
    return p


def _stored(spark: SparkSession, path: str | None) -> PreparedGraph | None:
    """The preparation in ``path``, or None where there is none yet."""
    if path is None:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mirrors/_SUCCESS")  # what ``save`` writes last
    return load(spark, path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.tiles % a.merge_factor:
        parser().error("the number of tiles must be a multiple of the merge factor")
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    config = textio.read_config(a.config) if a.config else gcn.GcnConfig()
    g = _stored(spark, a.prepared)
    if g is None:
        g = textio.read_graph(spark, a.edges, a.vertices if a.program in ("train", "infer") else None, a.partition, a.tiles // a.merge_factor, a.merge_factor, config.input_dim, a.undirected)
        if a.prepared:
            g.save(a.prepared)
            g = load(spark, a.prepared)
    if a.bump_degrees:
        g = messages.with_bumped_degrees(g)
    if a.program in ("train", "infer"):
        g = g.cache()
        # an epoch is three iterations a layer, or two where sums are kept
        per = (3 if a.kernel == "optimized" else 2) * config.num_layers
        epochs = max(1, a.max_iters // per)
        if a.program == "infer":
            weights = config.weights()
        elif a.log:
            weights = gcn.train_log(g, config, epochs, a.log, a.grad, a.kernel)
        else:
            weights = gcn.train(g, config, epochs, a.grad, kernel=a.kernel)
        p = gcn.predict(g, weights, a.kernel)
        metrics.accuracy_by_split(p, g, config.train_ratio, config.val_ratio).orderBy("tid", "metric").show(200, False)
        metrics.cross_entropy(p, g).orderBy("tid").show(200, False)
        out, name = p.select("vid", F.array_position("p", F.array_max("p")).alias("label")).withColumn("label", F.col("label") - 1), "label"
    elif a.program == "pagerank":
        out, name = programs.pagerank(g, a.max_iters, tolerance=1e-9), "rank"
    elif a.program == "paths":
        out, name = programs.shortest_paths(g, a.source, a.max_iters), "dist"
    else:
        out, name = programs.connected_components(g), "component"
    if a.output:
        textio.write_result(out, a.output, name)
    else:
        out.show()


if __name__ == "__main__":
    main()
