"""Every query with SQL against DuckDB; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from quillspark import queries as core

NAMES = list(core.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, data):
    return sorted(repr([None if isinstance(x, float) and math.isnan(x) else x for x in r]) for r in data), columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    df = core.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(columns, df.select(*columns).collect())
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got[0]
        return
    rel = duck.sql(sql)
    own = sorted(rel.columns)
    assert rows(own, rel.select(*(f'"{c}"' for c in own)).fetchall()) == got
