"""Every registered analysis against its SQL counterpart, at the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
# Queries of the optional subpackage have tests of their own.
QUERIES = {k: q for k, q in contract.queries().items() if k not in contract.LLM_QUERIES}
ORACLE = {k: q for k, q in contract.oracle_sql().items() if k not in contract.LLM_ORACLES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def in_order(rows, names):
    by_name = sorted(range(len(names)), key=names.__getitem__)
    picked = [tuple(row[i] for i in by_name) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_analysis_has_both_sides():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows_and_types(spark, duck, key):
    df = QUERIES[key](spark, SF)
    result = duck.execute(ORACLE[key])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert {n: TYPES[t] for n, t in df.dtypes} == types
    rows = [tuple(r) for r in df.collect()]
    assert rows
    assert in_order(rows, df.columns) == in_order(result.fetchall(), names)


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["month", "revenue", "growth_rate_pct"]
    assert df.count() > 0
