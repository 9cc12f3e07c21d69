import pytest
from pyspark.sql import functions as F

from graphloom.operators import gcn, messages, metrics, prep, programs
from graphloom.plans.components import components
from graphloom.plans.engine import Engine, Hooks
from graphloom.plans.prepared import GraphError, PreparedGraph, load
from graphloom.plans.staging import shared_dir


def graph(spark, pairs, tiles=2, n=None, symmetric=True):
    pairs = pairs + [(b, a) for a, b in pairs] if symmetric else pairs
    n = n or max((max(p) for p in pairs), default=-1) + 1
    v = spark.createDataFrame([(i, i % tiles, [float(i), 1.0], i % 2) for i in range(n)], "vid long, tid long, feature array<double>, label int")
    return PreparedGraph(v, spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long"), tiles)


def as_dict(df, k="vid"):
    return {r[k]: tuple(r[c] for c in df.columns if c != k) for r in df.collect()}


def test_path_has_only_border_vertices_and_mirrors(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    assert all(b for (b,) in as_dict(g.border).values())
    assert as_dict(g.in_degree) == {0: (1,), 1: (2,), 2: (2,), 3: (1,)}
    assert {(r.tid, r.vid, r.owner) for r in g.mirrors.collect()} == {(0, 1, 1), (0, 3, 1), (1, 0, 0), (1, 2, 0)}


def test_bag_counts_duplicates_and_loops(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 1)], symmetric=False)
    assert as_dict(g.in_degree) == {0: (0,), 1: (3,)}
    assert as_dict(g.out_degree) == {0: (2,), 1: (1,)}


def test_degree_sums_equal_edges(spark):
    g = graph(spark, [(0, i) for i in range(1, 8)], n=10)
    assert g.in_degree.agg(F.sum("in_degree")).first()[0] == g.edges.count() == g.out_degree.agg(F.sum("out_degree")).first()[0]


def test_check_rejects_contradictions(spark):
    g = graph(spark, [(0, 1)])
    with pytest.raises(GraphError):
        PreparedGraph(g.vertices.union(g.vertices), g.edges).check()
    with pytest.raises(GraphError):
        PreparedGraph(g.vertices.where("vid = 0"), g.edges).check()


def test_propagation_on_star_does_not_depend_on_tiles(spark):
    rows = {}
    for tiles in (1, 3):
        g = graph(spark, [(0, i) for i in range(1, 5)], tiles=tiles, n=6)
        out = messages.propagate(g, g.vertices.select("vid", F.col("feature").alias("h")), 2)
        rows[tiles] = {k: [round(x, 12) for x in v[0]] for k, v in as_dict(out).items()}
    assert rows[1] == rows[3]
    assert rows[1][5] == [5.0, 1.0]  # isolated: its own row, scale 1
    assert rows[1][0][1] == pytest.approx(1 / 5 + 4 / (5**0.5 * 2**0.5))


def test_degree_bump_needs_an_edge_from_another_tile_only(spark):
    g = graph(spark, [(0, 1), (0, 2)], tiles=2, symmetric=False)
    assert as_dict(messages.bumped_degrees(g)) == {0: (1,), 1: (2,), 2: (1,)}


def test_split_has_the_golden_sizes(spark):
    v = spark.range(542).select(F.col("id").alias("vid"), F.lit(0).cast("long").alias("tid"))
    g = PreparedGraph(v, spark.createDataFrame([], "src long, dst long, weight long"))
    assert {r["split"]: r["count"] for r in metrics.split_assign(g).groupBy("split").count().collect()} == {"train": 108, "val": 108, "test": 326}
    assert round(100 * 104 / 542, 6) == 19.188192


@pytest.mark.parametrize(("n", "parts"), [(17, 4), (5, 5), (3, 5), (100, 7)])
def test_blocks_are_those_of_array_split(spark, n, parts):
    import numpy as np

    want = {int(v): i for i, b in enumerate(np.array_split(np.arange(n), parts)) for v in b}
    assert {r.vid: r.part for r in prep.blocks(spark.range(n).withColumnRenamed("id", "vid"), parts).collect()} == want


def test_subset_and_reverse(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    assert {(r.src, r.dst) for r in prep.prefix_subset(g, 2, 0).edges.collect()} == {(0, 1), (1, 0)}
    assert prep.missing_reverse(g.edges).count() == 0
    assert prep.missing_reverse(g.edges.where("src < dst")).count() == 3


def test_components_of_chains_and_loops(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 200)]
    got = {r.vid: r.component for r in components(spark.createDataFrame(e, "src long, dst long"), folder=shared_dir(spark)).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[200] == 200
    assert components(spark.createDataFrame([], "src long, dst long"), folder=shared_dir(spark)).count() == 0


def test_vertex_programs(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 4)], n=6)
    assert as_dict(programs.shortest_paths(g, 0, 5)) == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert as_dict(programs.connected_components(g)) == {0: (0,), 1: (0,), 2: (0,), 3: (3,), 4: (3,), 5: (5,)}
    ranks = as_dict(programs.pagerank(g, 40, tolerance=1e-12))
    assert ranks[1][0] > ranks[0][0] == pytest.approx(ranks[2][0])
    assert ranks[5][0] == pytest.approx(0.15 / 6)


def test_engine_checks_tiles_and_programs_and_calls_hooks(spark):
    g = PreparedGraph(spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "vid long, tid long"), spark.createDataFrame([(0, 1, 1)], "src long, dst long, weight long"), 2)
    seen = []
    hooks = Hooks(before=seen.append, after=lambda name, df: df.withColumn("by", F.lit(name)), end=lambda found: seen.append(len(found)))
    e = Engine(g, hooks=hooks).add("in", lambda g: g.in_degree).add("gone", lambda g: g.parts).remove("gone")
    e.tiles = [1]
    assert [tuple(r) for r in e.run()["in"].collect()] == [(1, 1, "in")] and seen == ["in", 1] and e.programs == ["in"]
    for wrong in ([1, 0], [0, 0], [2]):
        with pytest.raises(GraphError):
            e.tiles = wrong
    with pytest.raises(GraphError):
        e.add("in", lambda g: g.parts)


def test_a_stored_preparation_is_read_not_computed(spark, tmp_path):
    g = PreparedGraph(spark.createDataFrame([(0, 0), (1, 1)], "vid long, tid long"), spark.createDataFrame([(0, 1, 1)], "src long, dst long, weight long"), 2)
    g.save(str(tmp_path / "p"))
    back = load(spark, str(tmp_path / "p"))
    assert back.tiles == 2 and back.vertices.columns == ["vid", "tid"]
    for name in ("in_degree", "out_degree", "border", "mirrors"):
        assert sorted(getattr(back, name).collect()) == sorted(getattr(g, name).collect())
    assert "Aggregate" not in back.in_degree._jdf.queryExecution().optimizedPlan().toString()


def test_training_log_has_every_epoch(spark, tmp_path):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9)], n=10)
    config = gcn.GcnConfig(input_dim=2, hidden_dim=2, num_labels=2)
    path = str(tmp_path / "log")
    gcn.train_log(g, config, 1, path)
    found = {(r["epoch"], r["tid"], r["metric"]): r["value"] for r in spark.read.parquet(path).collect()}
    assert {k[0] for k in found} == {0, 1} and len(found) == 2 * 2 * 8
    for r in metrics.cross_entropy(gcn.predict(g, config.weights()), g).collect():
        assert found[0, r["tid"], "cross_entropy"] == pytest.approx(r["loss"])
