import pytest

from graphloom.operators import runlog
from graphloom.plans.prepared import GraphError
from graphloom.sources import textio


def write(p, text):
    p.write_text(text)
    return str(p)


def test_files_make_a_graph_and_come_back(spark, tmp_path):
    edges = write(tmp_path / "e", "# c\n0 1\n\n1 2 7\n")
    parts = write(tmp_path / "p", "0 0\n1 1\n2 3\n")
    data = write(tmp_path / "v", "0 0.5 1 2\n1 1 2 0\n2 0 0 1\n9 1 1 1\n")
    g = textio.read_graph(spark, edges, data, parts, tiles=2, merge_factor=2, width=2, both_ways=True)
    assert {(r.src, r.dst, r.weight) for r in g.edges.collect()} == {(0, 1, 1), (1, 0, 1), (1, 2, 7), (2, 1, 7)}
    assert {(r.vid, r.tid, tuple(r.feature), r.label) for r in g.vertices.collect()} == {(0, 0, (0.5, 1.0), 2), (1, 0, (1.0, 2.0), 0), (2, 1, (0.0, 0.0), 1)}
    for writer, df, name in ((textio.write_edges, g.edges, "oe"), (textio.write_partition, g.parts, "op"), (textio.write_vertex_data, g.vertices, "ov")):
        writer(df, str(tmp_path / name))
    assert textio.read_edges(spark, str(tmp_path / "oe")).count() == 4
    assert textio.read_partition(spark, str(tmp_path / "op"), 2).count() == 3
    assert {tuple(r.feature) for r in textio.read_vertex_data(spark, str(tmp_path / "ov"), 2).collect()} == {(0.5, 1.0), (1.0, 2.0), (0.0, 0.0)}


def test_bad_partitions_are_named(spark, tmp_path):
    with pytest.raises(GraphError):
        textio.read_partition(spark, write(tmp_path / "a", "0 5\n"), 2)
    with pytest.raises(GraphError):
        textio.read_partition(spark, write(tmp_path / "b", "0 0\n0 1\n"), 2)


def test_config_stops_at_an_unknown_name(tmp_path):
    c = textio.read_config(write(tmp_path / "c", "num_layers : 2\ninput_dim : 8\nlearning_rate : 0.25\nwhat : 1\nhidden_dim : 99\n"))
    assert (c.input_dim, c.learning_rate, c.hidden_dim) == (8, 0.25, 16)


def test_log_numbers_torn_off_are_found(spark, tmp_path):
    log = write(tmp_path / "l", "::a took 1.5 seconds\n::b took ::c took 2 seconds\n3 seconds\ntest accuracy = 20.552147\n::d took\nnoise\n4.25 seconds\n")
    lines = textio.read_log(spark, log, 0)
    assert [(r.tag, r.seconds) for r in runlog.parse_durations(lines).orderBy("seq").collect()] == [("a", 1.5), ("b", 2.0), ("d", 4.25)]
    assert [(r.metric, r.value) for r in runlog.parse_metrics(lines).collect()] == [("test accuracy", 20.552147)]


def test_traffic_sorts_by_number(spark):
    rows = [(" 0 veth1 9.50MB 1.00MB",), (" 1 veth2 10.25MB 2.00MB",), (" 2 lo 99MB 1MB",), ("iface Download Upload",)]
    got = runlog.parse_traffic(spark.createDataFrame(rows, "value string"))
    assert [(r.iface, r.download_mb) for r in got.collect()] == [("veth2", 10.25), ("veth1", 9.5)]
    assert runlog.traffic_per_party(got, 2, 1).first()[0] == pytest.approx(22.75 / 2 / 1024)


def test_traffic_without_a_size_keeps_its_columns(spark, tmp_path):
    rows = spark.createDataFrame([(0, "veth0", 1618083840, None), (1, "veth1", None, 5)], "party long, iface string, down long, up long")
    textio.write_traffic(rows, str(tmp_path / "t"))
    lines = spark.read.text(str(tmp_path / "t"))
    assert sorted(r.value for r in lines.collect()) == ["0 veth0 1543.12MB nullMB", "1 veth1 nullMB 0.00MB"]
    assert [tuple(r) for r in runlog.parse_traffic(lines).collect()] == [("veth0", 1543.12, None)]


def test_streaming_degrees(spark, tmp_path):
    from graphloom.streaming.degrees import edge_stream, streaming_degrees

    src = str(tmp_path / "edges")
    spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 2, 1)], "src long, dst long, weight long").write.parquet(src)
    q = streaming_degrees(edge_stream(spark, src)).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.vid, r.out_degree, r.in_degree) for r in spark.table("deg").collect()} == {(0, 2, 0), (1, 1, 1), (2, 0, 2)}


def test_command_line_writes_a_result(spark, tmp_path):
    from graphloom.__main__ import main

    edges, out = write(tmp_path / "e", "0 1\n2 3\n"), str(tmp_path / "out")
    main(["components", edges, "-", "-", out, "-u"], spark)
    assert {tuple(map(int, r.value.split("\t"))) for r in spark.read.text(out).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2)}
