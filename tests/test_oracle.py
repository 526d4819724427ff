"""Every registered query that has SQL gives the rows that DuckDB gives; the others give rows."""

from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from cairn.plans import registry
from cairn.plans.bindings import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in BASE:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def value(v):
    """Integers, texts and times as they are; only floats are rounded, to twelve digits."""
    if isinstance(v, float):
        return None if v != v else f"{v:.12g}"
    if isinstance(v, Decimal):
        return int(v) if v == int(v) else f"{v:.12g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, dict):
        return tuple(sorted((k, value(x)) for k, x in v.items()))
    return v.replace(tzinfo=None) if isinstance(v, datetime) else bytes(v) if isinstance(v, bytearray) else v


def rows(names: list[str], found: list) -> list:
    """Rows with their columns by name, sorted."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


def test_integers_are_compared_exactly():
    big = 10995116277760001
    assert rows(["a"], [(big,)]) != rows(["a"], [(big + 1,)]) and rows(["a", "b"], [(1, 2)]) == rows(["b", "a"], [(2, 1)])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert len(got)
