"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexspan.plans import registry

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = canonical([tuple(r) for r in df.collect()], df.columns)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows == canonical(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
