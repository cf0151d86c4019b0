"""Every registered query against its SQL in DuckDB, and the shape of the plans that matter at scale."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("PLUMBLINE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = entry.queries()
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan(q["unique_combos"](spark, SF))
    assert "WindowGroupLimit" in plan(q["top_results"](spark, SF))
    assert "WindowGroupLimit" in plan(q["profile"](spark, SF))
    assert "TakeOrderedAndProject" in plan(q["curated"](spark, SF))
    assert "Exchange" not in plan(q["amend_inline"](spark, SF))
    assert "Exchange" not in plan(q["attachments"](spark, SF))
    assert entry.entry(spark).count() > 0
