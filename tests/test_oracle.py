"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want)
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b):
        assert x == y


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    if name == "pipeline" or name.startswith("op"):
        pytest.skip("tested in tests/llm")
    rows = entry.queries()[name](spark, DIR)
    assert rows.count() > 0
