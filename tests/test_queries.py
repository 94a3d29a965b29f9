"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.5f}" if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else str(v)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_runs(spark, name):
    rows = driver.queries()[name](spark, SF).collect()
    assert rows
    for r in rows:
        d = r.asDict()
        if d.get("f1") is not None:
            assert 0.0 <= d["f1"] <= 1.0 and d["threshold"] >= 0.3
        if d.get("gradient") is not None:
            assert d["gradient"] <= 1e-4


def test_entry(spark):
    assert {r["label"] for r in driver.entry(spark).collect()} == {"quality", "toxic"}
