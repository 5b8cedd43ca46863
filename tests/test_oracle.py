"""Every registered query with SQL gives the SQL's rows at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or repr(x) == "<NA>":
            return None
        return float(x) if not isinstance(x, (str, bool)) and hasattr(x, "__float__") else str(x)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_equal_poses_are_one_option(spark, tmp_path):
    con = duckdb.connect()
    # turns and moves of nothing on a path's first edge, on a ring's first and last edges, and none
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (1, 1, 5.0), (17, 1, 0.0), (3, 3, 7.0), (34, 3, 0.0), (5, 3, 90.0), (6, 3, 45.0), (51, 3, 0.0), (8, 6, 30.0), (9, 6, 20.0), (10, 6, 0.0)) x(event_id, user_id, value)")
    con.execute("CREATE OR REPLACE TABLE events AS SELECT CAST(event_id AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(user_id AS BIGINT) AS user_id, 'view' AS event_type, CAST(value AS DOUBLE) AS value, '{}' AS props FROM events")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("i07_pose_search", "i08_assembly_audit"):
        assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())
