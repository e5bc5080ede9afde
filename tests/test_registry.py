"""Every registered query equals its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessera import registry


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return int(v) if isinstance(v, bool) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    got = registry.queries()[name](spark, small)
    told = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, small, name):
    assert registry.queries()[name](spark, small).limit(5).count() > 0


def test_entry_imports_and_has_flagship(spark):
    import __spark_entry__

    assert "evidence_filter_and" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
