"""Every query runs; those with SQL give the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from rankspark.plans import catalogue


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert all(kind != "void" for _, kind in df.dtypes)
    if name not in catalogue.oracle_sql():
        return
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == order
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_names_are_unique():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
