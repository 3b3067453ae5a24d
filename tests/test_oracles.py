"""Every query that has SQL against DuckDB on the same tables."""

import duckdb
import pytest
from pyspark.sql import Row

import __spark_entry__

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple, Row)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {n for n in QUERIES if n.startswith("op") or n == "pipeline"}))
def test_query_without_sql_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.stream for r in rows} == {"click", "error", "purchase", "signup", "view"}
