"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from cuelattice.queries import registry

SQL = registry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(sf + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got or name in {"repeat_gap_violations"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_plans_have_no_product(spark, sf):
    for name in ("section_of_sound", "interval_overlap_ratio", "cut_alignment_qa", "p6_found"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
