import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom import oracles, queries
from graphloom.functions import scalars
from tests.oracle import assert_same, connection

SF = "/root/testdata/sf0.001"
NAMES = ["degree_in", "border_vertices", "tile_stats", "block_partition", "gcn_propagate", "gather_masked", "gcn_inference", "grad_w0_optimized", "grad_w0_original", "grad_w1_original", "grad_w0_delayed", "grad_w1_delayed", "weight_average", "gcn_forward_original", "share_linear_sum", "sssp_parent", "connected_components", "log_parse", "mapped_degrees", "accuracy_log", "integer_functions",
         "engine_programs", "prepared_resume", "edges_dealt", "degree_bump_propagate", "vector_program", "pair_reveal", "accuracy_per_epoch", "log_first_matches", "traffic_table", "traffic_by_party"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, SF, queries.QUERIES[name], oracles.ORACLE_SQL[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(oracles.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_traffic_text_rounds_like_its_sql_beyond_the_test_tables(spark, tmp_path):
    """Sizes that end in 1/8 MB are ties; the first one is event 131072, above every event of sf0.1."""
    ids = [0, 1, 131071, 131072, 393216, 655360, 917504, 99999999, 10**15 + 7, 2**63 - 1, -1, -131072, -655360, -(2**63), None]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64())}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {r.event_id: r.label for r in queries.QUERIES["traffic_text"](spark, str(tmp_path)).collect()}
    assert len(got) == len(ids) and got == dict(con.sql(oracles.ORACLE_SQL["traffic_text"]).fetchall())
    assert got[131072] == "1543.12MB" and got[None] is None


def test_megabytes_rounds_the_exact_value(spark):
    near = [(2 * m + 1) / 200 for m in range(400)]
    sizes = near + [math.nextafter(x, to) for x in near for to in (0, math.inf)] + [0.0, -0.0, -0.001, 0.995, 0.125, -0.125, 1e-300, 2.0**50 + 0.25, 2.0**53 + 2, 9223372036854774784.0]
    rows = spark.createDataFrame([(x * 1048576.0,) for x in sizes], "n double").select("n", scalars.megabytes(F.col("n")).alias("label")).collect()
    assert [r.label for r in rows] == [f"{r.n / 1048576.0:.2f}MB" for r in rows]
