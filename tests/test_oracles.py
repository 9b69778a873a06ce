"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if v is not None else ""


@pytest.mark.parametrize("name", sorted(k for k in ORACLES if not k.startswith("op")))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = con.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()], key=repr)
    assert sorted([tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()], key=repr) == want


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLES and not k.startswith("op") and k != "pipeline"))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
