"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from factloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    return con


def same_form(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(columns), sorted(tuple(str(value(r[k])) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, small):
    got = QUERIES[name](spark, small)
    want = duck.execute(SQL[name])
    assert same_form(got.columns, [tuple(r) for r in got.collect()]) == same_form([d[0] for d in want.description], want.fetchall())


def test_ids_do_not_change(spark, small):
    first, second = ({tuple(r) for r in QUERIES["deterministic_ids"](spark, small).collect()} for _ in range(2))
    assert first == second and len(first) == 210
