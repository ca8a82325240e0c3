"""Every registered query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from dayfield import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, "" if isinstance(v, (int, float)) or v is None else str(v), v if isinstance(v, (int, float)) else 0) for v in r])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_duckdb(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in plans.ORACLES:
        return
    found = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert len(mine) == len(theirs)
    for a, b in zip(ordered(mine), ordered(theirs), strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=2e-6) if all(isinstance(v, (int, float)) for v in a) else a == b


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
