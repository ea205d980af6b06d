"""Every registered query against an independent engine over the same tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from stratiform.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: "" if v is None or v != v else str(v))
        elif "datetime" in str(frame[c].dtype):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        else:
            frame[c] = frame[c].astype(float).round(8).replace(np.nan, -1e99)
    return sorted(map(tuple, frame.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_delta_batches_of_events_without_ids_and_before_1970(spark, tmp_path):
    rows = "('id', NULL, '2024-01-01 00:00:01', 1.0), ('id', 5, '2024-01-01 00:00:01', 2.0), ('time', NULL, NULL, 3.0), ('time', -2, NULL, 4.0), ('old', 1, '1969-12-31 22:59:59.9999', 5.0), ('old', 2, '1969-12-31 23:00:00', 6.0), ('tie', 1, '2024-01-01 00:00:01', 8.0), ('tie', 1, '2024-01-01 00:00:01', 7.0), ('null', 1, '2024-01-01 00:00:02', NULL), ('null', 1, '2024-01-01 00:00:01', 9.0)"
    c = duckdb.connect()
    c.execute(f"COPY (SELECT id::BIGINT AS event_id, ts::TIMESTAMP AS ts, 1::BIGINT AS user_id, kind AS event_type, value::DOUBLE AS value FROM (VALUES {rows}) t(kind, id, ts, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = {tuple(r)[1:] for r in QUERIES["delta_batches"](spark, str(tmp_path)).collect()}
    assert got == {("id", 473352, 2.0, 2), ("time", None, 4.0, 2), ("old", -2, 5.0, 1), ("old", -1, 6.0, 1), ("tie", 473352, 8.0, 2), ("null", 473352, 9.0, 2)}
    assert got == {r[1:] for r in c.execute(ORACLES["delta_batches"]).fetchall()}
