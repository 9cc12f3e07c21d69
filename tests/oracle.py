"""Compares a query with its SQL in DuckDB, order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 5) + 0.0
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


def assert_same(spark, con, sf_dir, query, sql):
    got, want = rows_of(query(spark, sf_dir).toPandas()), rows_of(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
