"""Registered queries of the graph engine, each over the whole canonical graph of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions import tasks
from graphloom.operators import gcn, messages, metrics, prep, programs, runlog, shares
from graphloom.operators import vectors as V
from graphloom.plans.engine import Engine
from graphloom.plans.prepared import PreparedGraph, base_edges, from_tables, load
from graphloom.plans.staging import shared_dir, staged
from graphloom.sources import textio

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = gcn.GcnConfig()
ROUNDS = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str) -> Column:
    """Six decimals, and no negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


# --- graph preparation


@query
def degree_in(spark, d):
    return from_tables(spark, d).in_degree


@query
def degree_out(spark, d):
    return from_tables(spark, d).out_degree


@query
def bag_degrees(spark, d):
    """Degrees of the directed bag: duplicates and loops count."""
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    b = base_edges(spark, d, n)
    ends = b.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.vid").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


@query
def edges_undirected(spark, d):
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    return prep.undirected(base_edges(spark, d, n)).groupBy("src", "dst").agg(F.count("*").alias("copies"))


@query
def mapped_degrees(spark, d):
    return from_tables(spark, d).degree_edges


@query
def tile_lookup(spark, d):
    return from_tables(spark, d).tiled_edges.select("src", "dst", "src_tid", "dst_tid")


@query
def border_vertices(spark, d):
    return from_tables(spark, d).border


@query
def mirror_vertices(spark, d):
    return from_tables(spark, d).mirrors


@query
def tile_stats(spark, d):
    """Per tile: vertices, owned edges, remote edges, mirrors, border vertices, longest in-list."""
    g = from_tables(spark, d)
    v = g.vertices.join(g.border, "vid").join(g.in_degree, "vid").groupBy("tid").agg(F.count("*").alias("vertices"), F.count_if("is_border").alias("border"), F.max("in_degree").alias("longest_in_list"))
    e = g.tiled_edges.groupBy(F.col("src_tid").alias("tid")).agg(F.count("*").alias("edges"), F.count_if(F.col("src_tid") != F.col("dst_tid")).alias("remote_edges"))
    m = g.mirrors.groupBy("tid").agg(F.count("*").alias("mirrors"))
    return v.join(e, "tid", "left").join(m, "tid", "left").na.fill(0)


@query
def inter_edge_ratio(spark, d):
    return runlog.inter_edge_ratio(from_tables(spark, d).edges, [2, 3, 4, 5]).select("tiles", r6("ratio"))


@query
def reordered_index(spark, d):
    return metrics.reordered_index(from_tables(spark, d)).select("vid", "tid", "idx")


@query
def split_assign(spark, d):
    return metrics.split_assign(from_tables(spark, d))


@query
def block_partition(spark, d):
    return prep.blocks(from_tables(spark, d).vertices, 5)


@query
def round_robin_partition(spark, d):
    v = from_tables(spark, d).vertices
    return v.select("vid", F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("parties"), F.pmod("vid", F.lit(p)).cast("long").alias("tid")) for p in (2, 3, 4, 5)])).alias("x")).select("vid", "x.parties", "x.tid")


@query
def prefix_subset_edges(spark, d):
    return prep.prefix_subset(from_tables(spark, d), 5, 1).edges.select("src", "dst")


@query
def is_undirected(spark, d):
    return prep.missing_reverse(from_tables(spark, d).edges).agg((F.count("*") == 0).alias("undirected"))


@query
def edge_sort_rank(spark, d):
    """Place of each edge in its source's list, ordered by destination."""
    return from_tables(spark, d).edges.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("dst")).cast("long").alias("place"))


@query
def in_adjacency(spark, d):
    return prep.in_lists(from_tables(spark, d).edges).select("vid", F.concat_ws(",", F.transform("sources", lambda x: x.cast("string"))).alias("sources"))


@query
def implicit_vertices(spark, d):
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    return prep.implicit_vertices(base_edges(spark, d, n))


@query
def tile_merge(spark, d):
    g = from_tables(spark, d, tiles=6)
    return g.parts.select("vid", S.merged_tile(F.col("tid"), 2).alias("tid"))


# --- scalar functions


@query
def norm_factor(spark, d):
    x = from_tables(spark, d).in_degree
    return x.select("vid", S.inverse_root(F.col("in_degree")).alias("plus_one"), S.inverse_root_legacy(F.col("in_degree")).alias("legacy")).select("vid", r6("plus_one"), r6("legacy"))


@query
def integer_functions(spark, d):
    x = from_tables(spark, d).in_degree
    n = F.col("in_degree")
    return x.select("vid", S.integer_log2(n).alias("log2"), S.next_power_of_two(n).alias("next_pow2"), S.is_power_of_two(n).alias("is_pow2"), S.next_party(F.col("vid"), 5).alias("next_party"), S.previous_party(F.col("vid"), 5).alias("previous_party"), F.greatest(n, F.lit(20)).alias("at_least"), F.least(n, F.lit(20)).alias("at_most"))


@query
def tokenize(spark, d):
    o = spark.read.parquet(f"{d}/part.parquet")
    return o.select("p_partkey", F.posexplode(S.tokens(F.col("p_name"), " -#,"))).toDF("p_partkey", "place", "token")


# --- message passing


@query
def feature_prescale(spark, d):
    g = from_tables(spark, d).cache()
    x = g.vertices.join(g.scale, "vid").select("vid", V.scaled(F.col("feature"), F.col("s")).alias("h"))
    return V.long_form(x, "h", ["vid"])


@query
def scatter_src_map(spark, d):
    """Source values on edges, inside and between tiles, as per-edge sums of the vector."""
    g = from_tables(spark, d).cache()
    return messages.source_values(g, gcn.features(g)).select("src", "dst", "inter", V.row_sum(F.col("h")).alias("value")).select("src", "dst", "inter", r6("value"))


@query
def premerge_by_tile(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(messages.premerged(g, gcn.features(g), CONFIG.input_dim), "h", ["tid", "vid"])


@query
def gather_masked(spark, d):
    g = from_tables(spark, d).cache()
    h = gcn.features(g)
    return V.long_form(messages.gathered(g, h, messages.premerged(g, h, CONFIG.input_dim), 1), "h", ["vid"])


@query
def gcn_propagate(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(messages.propagate(g, gcn.features(g), CONFIG.input_dim), "h", ["vid"])


@query
def propagate_original(spark, d):
    g = from_tables(spark, d).cache()
    h = g.vertices.join(g.scale, "vid").select("vid", V.scaled(F.col("feature"), F.col("s")).alias("h"))
    return V.long_form(messages.propagate_per_edge(g, h, CONFIG.input_dim), "h", ["vid"])


@query
def degree_bump(spark, d):
    return messages.bumped_degrees(from_tables(spark, d))


# --- linear algebra


def _w0():
    return CONFIG.weights()[0]


@query
def matmul(spark, d):
    h = gcn.features(from_tables(spark, d))
    return V.long_form(h.select("vid", V.times_matrix(F.col("h"), _w0()).alias("h")), "h", ["vid"])


@query
def matmul_dense(spark, d):
    h = gcn.features(from_tables(spark, d))
    return V.long_form(V.times_matrix_dense(h, "h", _w0(), "m"), "m", ["vid"])


@query
def matmul_then_propagate(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(gcn.layer(g, gcn.features(g), _w0(), "matmul_first"), "h", ["vid"])


@query
def propagate_then_matmul(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(gcn.layer(g, gcn.features(g), _w0(), "propagate_first"), "h", ["vid"])


@query
def gram_matrix(spark, d):
    """Features transposed times features, by long-form transpose and join."""
    x = from_tables(spark, d).vertices.select(F.col("vid").alias("i"), F.posexplode("feature").alias("j", "w"))
    return V.matmul_long(V.transposed(x), x).select("i", "j", r6("w"))


@query
def relu(spark, d):
    h = gcn.features(from_tables(spark, d))
    return V.long_form(h.select("vid", V.relu(F.col("h")).alias("h")), "h", ["vid"])


@query
def softmax(spark, d):
    h = gcn.features(from_tables(spark, d))
    return V.long_form(h.select("vid", V.softmax(F.col("h")).alias("h")), "h", ["vid"])


@query
def transpose(spark, d):
    w = gcn.weight_frame(spark, _w0())
    return V.transposed(w).select("i", "j", r6("w"))


@query
def onehot(spark, d):
    v = from_tables(spark, d).vertices
    return V.long_form(v.select("vid", V.one_hot(F.col("label"), 10).alias("h")), "h", ["vid"])


@query
def feature_row_sum(spark, d):
    return from_tables(spark, d).vertices.select("vid", V.row_sum(F.col("feature")).alias("total")).select("vid", r6("total"))


@query
def vector_scale_two(spark, d):
    """Each vector times two factors of its own vertex."""
    g = from_tables(spark, d).cache()
    x = g.vertices.join(g.scale, "vid").select("vid", V.scaled(V.scaled(F.col("feature"), F.col("s")), F.col("label").cast("double")).alias("h"))
    return V.long_form(x, "h", ["vid"])


@query
def glorot_weights(spark, d):
    return gcn.weight_frame(spark, _w0()).select("i", "j", r6("w"))


# --- graph convolution


@query
def gcn_forward(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(gcn.forward(g, CONFIG.weights())[-1], "h", ["vid"])


@query
def gcn_forward_delayed(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(gcn.forward(g, CONFIG.weights(), "delayed")[-1], "h", ["vid"])


@query
def gcn_forward_original(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(gcn.forward(g, CONFIG.weights(), "original")[-1], "h", ["vid"])


@query
def gcn_inference(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(gcn.predict(g, CONFIG.weights()), "p", ["vid"])


@query
def p_minus_y_masked(spark, d):
    g = from_tables(spark, d).cache()
    return V.long_form(metrics.masked_error(gcn.predict(g, CONFIG.weights()), g, CONFIG.train_ratio), "h", ["vid"])


@query
def cross_entropy(spark, d):
    g = from_tables(spark, d).cache()
    return metrics.cross_entropy(gcn.predict(g, CONFIG.weights()), g).select("tid", r6("loss"))


@query
def accuracy_by_split(spark, d):
    g = from_tables(spark, d).cache()
    return metrics.accuracy_by_split(gcn.predict(g, CONFIG.weights()), g).select("tid", "metric", r6("value"))


def _gradient(spark, d, k, mode, kernel="optimized"):
    g = from_tables(spark, d).cache()
    return gcn.gradients(g, CONFIG.weights(), CONFIG.train_ratio, mode, kernel=kernel, first=k)[0].select("tid", "i", "j", r6("w"))


@query
def grad_w1(spark, d):
    return _gradient(spark, d, 1, "full")


@query
def grad_w0_full(spark, d):
    return _gradient(spark, d, 0, "full")


@query
def grad_w0_optimized(spark, d):
    return _gradient(spark, d, 0, "optimized")


@query
def grad_w1_original(spark, d):
    return _gradient(spark, d, 1, "full", "original")


@query
def grad_w0_original(spark, d):
    return _gradient(spark, d, 0, "full", "original")


@query
def grad_w1_delayed(spark, d):
    return _gradient(spark, d, 1, "full", "delayed")


@query
def grad_w0_delayed(spark, d):
    return _gradient(spark, d, 0, "full", "delayed")


@query
def sgd_step(spark, d):
    g = from_tables(spark, d).cache()
    w = CONFIG.weights()
    return gcn.sgd_step(gcn.weight_frame(spark, w[1]), gcn.gradients(g, w, CONFIG.train_ratio, first=1)[0], CONFIG.learning_rate).select("tid", "i", "j", r6("w"))


@query
def weight_average(spark, d):
    g = from_tables(spark, d).cache()
    w = CONFIG.weights()
    return gcn.average_weights(gcn.sgd_step(gcn.weight_frame(spark, w[1]), gcn.gradients(g, w, CONFIG.train_ratio, first=1)[0], CONFIG.learning_rate)).select("i", "j", r6("w"))


@query
def gcn_train_epochs(spark, d):
    """Loss per tile after two epochs; a multi-epoch program has no SQL twin; tests assert that training lowers the loss."""
    g = from_tables(spark, d).cache()
    w = gcn.train(g, CONFIG, 2)
    return metrics.cross_entropy(gcn.predict(g, w), g).select("tid", r6("loss"))


@query
def epoch_schedule(spark, d):
    rows = [(k, i, what, passes, width) for k in ("optimized", "original") for i, (what, passes, width) in enumerate(gcn.schedule(CONFIG, k))]
    return spark.createDataFrame(rows, "kernel string, iter long, step string, messages boolean, width long")


# --- shares


def _components(spark, d):
    return from_tables(spark, d).vertices.select("vid", F.posexplode("feature").alias("k", "x"))


@query
def fixed_point_encode(spark, d):
    return _components(spark, d).select("vid", "k", S.encode_fixed(F.col("x")).alias("code"))


@query
def share_split(spark, d):
    s = shares.split(_components(spark, d))
    return s.select("vid", "k", F.col("share0").cast("string").alias("share0"), F.col("share1").cast("string").alias("share1"))


@query
def share_reconstruct(spark, d):
    s = shares.split(_components(spark, d))
    return s.select("vid", "k", shares.reconstruct(F.col("share0"), F.col("share1")).alias("value")).select("vid", "k", r6("value"))


@query
def share_linear_sum(spark, d):
    """Shares summed over in-edges: their sum decodes to the sum of the values."""
    g = from_tables(spark, d)
    s = shares.split(_components(spark, d))
    sent = g.edges.select("src", "dst").join(s.withColumnRenamed("vid", "src"), "src")
    both = sent.groupBy(F.col("dst").alias("vid"), "k").agg(shares.ring_sum(F.col("share0")).alias("a"), shares.ring_sum(F.col("share1")).alias("b"))
    return both.select("vid", "k", F.col("a").cast("string").alias("share0"), shares.reconstruct(F.col("a"), F.col("b")).alias("value")).select("vid", "k", "share0", r6("value"))


@query
def ring_scale(spark, d):
    s = shares.split(_components(spark, d))
    return s.select("vid", "k", shares.ring_scale(F.col("share0"), 1000).cast("string").alias("scaled"))


@query
def share_weights(spark, d):
    w = gcn.weight_frame(spark, _w0())
    s = shares.split(w, ("i", "j"), "w", seed=1)
    return s.select("i", "j", F.col("share0").cast("string").alias("share0"), F.col("share1").cast("string").alias("share1"))


# --- vertex programs


def _weighted(spark, d) -> PreparedGraph:
    g = from_tables(spark, d)
    return PreparedGraph(g.vertices, g.edges.withColumn("weight", F.lit(1) + F.pmod(F.col("src") * 7 + F.col("dst") * 7, F.lit(5))), g.tiles)


def _source(g: PreparedGraph) -> int:
    return g.edges.agg(F.min("src")).first()[0]


@query
def pagerank(spark, d):
    return programs.pagerank(from_tables(spark, d).cache(), 5).select("vid", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query
def sssp_parent(spark, d):
    g = _weighted(spark, d).cache()
    found = programs.shortest_paths(g, _source(g), ROUNDS)
    return found.select("vid", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("dist", "parent")])


@query
def bfs_levels(spark, d):
    g = from_tables(spark, d).cache()
    return programs.bfs_levels(g, _source(g), ROUNDS).select("vid", F.coalesce("level", F.lit(-1)).alias("level"))


@query
def connected_components(spark, d):
    return programs.connected_components(from_tables(spark, d))


@query
def pair_add(spark, d):
    g = from_tables(spark, d)
    h = PreparedGraph(g.vertices.select("vid", "tid", F.col("feature")[0].alias("x")), g.edges, g.tiles)
    return programs.pair_sums(h).select("vid", r6("total"), "count")


@query
def safe_div(spark, d):
    g = from_tables(spark, d)
    x = g.vertices.join(g.in_degree, "vid").select("vid", S.safe_divide(F.col("feature")[0], F.col("in_degree").cast("double")).alias("value"))
    return x.select("vid", r6("value"))


@query
def degree_order(spark, d):
    """The ten vertices of most in-edges in each tile."""
    g = from_tables(spark, d)
    w = Window.partitionBy("tid").orderBy(F.desc("in_degree"), "vid")
    return g.in_degree.join(g.parts, "vid").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("tid", "place", "vid", "in_degree")


@query
def task_algebra(spark, d):
    """Every task of the algebra on the vertices' own numbers."""
    g = from_tables(spark, d)
    x = g.vertices.join(g.in_degree, "vid").select("vid", F.col("feature")[0].alias("a"), F.col("feature")[1].alias("b"), F.col("in_degree").alias("n"))
    pair = lambda v, c: F.struct(F.col(v).alias("value"), F.col(c).alias("count"))
    state = lambda v: F.struct(F.col(v).alias("value"), F.col("vid").alias("parent"))
    t = x.select(
        "vid", tasks.add(F.col("a"), F.col("b")).alias("add"), tasks.add_pair(pair("a", "n"), pair("b", "vid")).alias("p"),
        tasks.min_with_parent(state("a"), tasks.replace_parent(state("b"), F.lit(-1).cast("long"))).alias("m"),
        tasks.add_with_replaced_parent(state("a"), F.col("n"), F.col("n")).alias("w"), tasks.divide(F.col("a"), F.col("n").cast("double")).alias("q"),
        tasks.swap(F.col("a"), F.col("b")).alias("s"), tasks.masked(F.col("b"), F.col("a"), F.col("n") % 2 == 0).alias("k"),
    )
    flat = t.select("vid", "add", F.col("p.value").alias("pair_value"), F.col("p.count").alias("pair_count"), F.col("m.value").alias("least"), F.col("m.parent").alias("least_parent"), F.col("w.value").alias("moved"), F.col("w.parent").alias("moved_parent"), F.col("q").alias("quotient"), F.col("s.first").alias("swapped"), F.col("k").alias("masked"))
    return flat.select("vid", "pair_count", "least_parent", "moved_parent", *[r6(c) for c in ("add", "pair_value", "least", "moved", "quotient", "swapped", "masked")])


@query
def segmented_prefix_sum(spark, d):
    """Running sums of the sources' first feature along each in-list."""
    g = from_tables(spark, d)
    sent = g.edges.join(g.vertices.select(F.col("vid").alias("src"), F.col("feature")[0].alias("x")), "src")
    return sent.select("src", "dst", F.sum("x").over(Window.partitionBy("dst").orderBy("src")).alias("total")).select("src", "dst", r6("total"))


@query
def barrier_and(spark, d):
    """Per tile, whether every vertex has an in-edge."""
    g = from_tables(spark, d)
    return g.parts.join(g.in_degree, "vid").groupBy("tid").agg(tasks.all_agree(F.col("in_degree") > 0).alias("agreed"))


# --- run-log analytics, on the event table read as a log


def _runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("party").orderBy("event_id")
    return e.select("event_id", F.pmod("user_id", F.lit(4)).alias("party"), F.col("event_type").alias("tag"), F.col("value").alias("seconds")).withColumn("iter", (F.row_number().over(w) - 1).cast("long"))


@query
def comm_model(spark, d):
    return runlog.cost_models(spark).select("dataset", "model", r6("gb"))


@query
def epoch_duration(spark, d):
    return runlog.epoch_durations(_runs(spark, d), 6).select("party", "epoch", r6("seconds"))


@query
def party_mean(spark, d):
    return runlog.party_mean(runlog.epoch_durations(_runs(spark, d), 6)).select("epoch", r6("seconds"))


@query
def stage_breakdown(spark, d):
    return runlog.stage_breakdown(_runs(spark, d), 90.0).select("tag", r6("seconds"), r6("share"))


@query
def online_preprocess_split(spark, d):
    rows = _runs(spark, d).select("party", (F.col("event_id") % 2 == 0).alias("with_prep"), "seconds")
    return runlog.online_split(rows, 90.0).select("party", r6("preprocess"), r6("online"))


@query
def speedup_growth(spark, d):
    per = _runs(spark, d).groupBy((F.col("party") + 2).alias("parties")).agg(F.sum("seconds").alias("slow"), F.sum(F.when(F.col("event_id") % 3 == 0, F.col("seconds")).otherwise(0.0)).alias("fast"))
    return runlog.speedups(per).select("parties", r6("speedup"), r6("growth"))


@query
def log_parse(spark, d):
    """Durations parsed back out of log lines; every seventh number is torn off onto a line of its own."""
    r = _runs(spark, d)
    # the text of a duration comes from whole milliseconds, which both engines write alike
    ms = F.floor(F.col("seconds") * 1000).cast("long")
    num = F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))
    torn = F.col("event_id") % 7 == 0
    head = F.struct((F.col("iter") * 2).alias("seq"), F.concat(F.lit("::"), "tag", F.lit(" took "), F.when(torn, F.lit("...")).otherwise(F.concat(num, F.lit(" seconds")))).alias("value"))
    tail = F.struct((F.col("iter") * 2 + 1).alias("seq"), F.when(torn, F.concat(num, F.lit(" seconds"))).otherwise(F.lit("noise")).alias("value"))
    lines = r.select("party", F.explode(F.array(head, tail)).alias("x")).select("party", "x.seq", "x.value")
    return runlog.parse_durations(lines).select("party", "seq", "tag", r6("seconds"))


@query
def accuracy_log(spark, d):
    """Accuracies read back out of log lines, as means of each party; every fifth line is of another kind."""
    e = spark.read.parquet(f"{d}/events.parquet")
    percent = F.concat(F.pmod("event_id", F.lit(100)).cast("string"), F.lit("."), F.pmod("user_id", F.lit(10)).cast("string"), F.lit("%"))
    line = F.concat(F.lit("[Part: "), F.pmod("user_id", F.lit(4)).cast("string"), F.lit("] Epoch: 3, Test accuracy: "), percent, F.lit(" Test is_border accuracy: "), percent)
    lines = e.select(F.when(F.col("event_id") % 5 == 0, F.lit("[Part: 9] Loss: 0.5")).otherwise(line).alias("value"))
    return runlog.party_accuracy(runlog.parse_accuracy(lines)).select("part", "runs", r6("test_acc"), r6("border_acc"))


@query
def traffic_text(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", S.megabytes(F.col("event_id").cast("double") * 12345).alias("label"))


# --- engine, resume, hooks


@query
def engine_programs(spark, d):
    """Three programs one after the other on one engine, for two of its tiles."""
    runs = Engine(from_tables(spark, d), tiles=[0, 2])
    runs.add("in", lambda g: g.in_degree.select("vid", F.col("in_degree").alias("value")))
    runs.add("out", lambda g: g.out_degree.select("vid", F.col("out_degree").alias("value")))
    runs.add("border", lambda g: g.border.select("vid", F.col("is_border").cast("long").alias("value")))
    found = [df.select(F.lit(name).alias("program"), "vid", "value") for name, df in runs.run().items()]
    return found[0].union(found[1]).union(found[2])


@query
def prepared_resume(spark, d):
    """Degrees, border and mirrors of a preparation that was written and read back."""
    path = f"{shared_dir(spark)}/prepared-{uuid.uuid4().hex}"
    from_tables(spark, d).save(path)
    g = load(spark, path)
    near = g.mirrors.groupBy("vid").agg(F.count("*").alias("mirrors"))
    return g.in_degree.join(g.out_degree, "vid").join(g.border, "vid").join(near, "vid", "left").select("vid", "in_degree", "out_degree", "is_border", F.coalesce("mirrors", F.lit(0)).cast("long").alias("mirrors"))


@query
def edges_dealt(spark, d):
    """Edges dealt by their source's remainder, and what each part holds."""
    parts = prep.dealt(from_tables(spark, d).edges, "src", 4)
    return parts.groupBy("part").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@query
def degree_bump_propagate(spark, d):
    """Propagation with one more for vertices without an in-edge from their own tile, as an option of the graph."""
    g = messages.with_bumped_degrees(from_tables(spark, d))
    return V.long_form(messages.propagate(g, gcn.features(g), CONFIG.input_dim), "h", ["vid"])


@query
def vector_program(spark, d):
    """Two rounds of a program of hooks: half of the vector goes out, summed per sending tile first, and the mean stays."""
    g = from_tables(spark, d)
    half = messages.VectorProgram(
        pre_scatter=lambda: V.scaled(F.col("h"), F.lit(0.5)), scatter=lambda: V.scaled(F.col("h"), F.col("weight").cast("double")),
        apply=lambda: V.scaled(F.col("h"), F.lit(1.0) / (F.col("in_degree") + 1)), pre_merge=True,
    )
    found = messages.run_vector_rounds(_of_weight_two(g), gcn.features(g), CONFIG.input_dim, half, 2, cut=lambda h: staged(h, "vector-program"))
    return V.long_form(found, "h", ["vid"])


def _of_weight_two(g: PreparedGraph) -> PreparedGraph:
    return PreparedGraph(g.vertices, g.edges.withColumn("weight", F.lit(2).cast("long")), g.tiles)


@query
def pair_reveal(spark, d):
    """Pairs of the first two components, shared and revealed part by part."""
    x = from_tables(spark, d).vertices.select("vid", F.col("feature")[0].alias("x"), F.col("feature")[1].alias("y"), F.lit(0).alias("k"), F.lit(1).alias("l"))
    one = shares.split(x).withColumnsRenamed({"share0": "x0", "share1": "x1"})
    two = shares.split(one, ("vid", "l"), "y")
    pair = lambda a, b: F.struct(F.col(a).alias("first"), F.col(b).alias("second"))
    return two.select("vid", tasks.reveal_pair(pair("x0", "share0"), pair("x1", "share1")).alias("p")).select("vid", F.col("p.first").alias("first"), F.col("p.second").alias("second")).select("vid", r6("first"), r6("second"))


@query
def accuracy_per_epoch(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.lit("[Part: 1] Epoch: "), F.pmod("event_id", F.lit(20)).cast("string"), F.lit(", Test accuracy: "), F.pmod("user_id", F.lit(100)).cast("string"), F.lit(".5%"))
    return runlog.epoch_accuracy(e.select(text.alias("value"))).select("epoch", "lines", r6("test_acc"), r6("best"))


@query
def log_first_matches(spark, d):
    """The first five lines of each party that name a tag with a c."""
    lines = _runs(spark, d).select("party", F.col("iter").alias("seq"), F.concat(F.lit("::"), "tag", F.lit(" took")).alias("value"))
    return runlog.first_matches(lines, "^::[a-z_]*c", 5)


def _traffic(spark, d) -> DataFrame:
    """The traffic of the event table, written as a text table and read back."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.groupBy(F.pmod("user_id", F.lit(16)).alias("party")).agg(F.sum(F.col("event_id") * 1000).alias("down"), F.sum(F.col("user_id") * 1000).alias("up")).withColumn("iface", F.concat(F.lit("veth"), F.col("party").cast("string")))
    path = f"{shared_dir(spark)}/traffic-{uuid.uuid4().hex}"
    textio.write_traffic(rows, path)
    return runlog.parse_traffic(spark.read.text(path))


@query
def traffic_table(spark, d):
    return _traffic(spark, d)


@query
def traffic_by_party(spark, d):
    return runlog.traffic_per_party(_traffic(spark, d), 16, 3).select(r6("gb"))
