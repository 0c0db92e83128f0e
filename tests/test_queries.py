"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from confab.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple("NULL" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
        assert columns == [found.description[i][0] for i in order]
        assert plain(rows) == plain([[r[i] for i in order] for r in found.fetchall()])


def test_streams_equal_batch(spark):
    from confab.operators.clean import dedup_lookback
    from confab.plans.adapters import events

    got = registry.QUERIES["stream_lookback"](spark, SF).select("source_path", "msg_index").collect()
    want = dedup_lookback(registry._messages(events(spark, SF))).select("source_path", "msg_index").collect()
    assert sorted(got) == sorted(want)
