import math
import os

import duckdb
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def alike(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: str([round(v, 6) if isinstance(v, float) else v for v in r]))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_oracle(spark, sf_dir, oracle, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = oracle.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = ordered([r[c] for c in columns] for r in got.collect())
    b = ordered([r[want.columns.index(c)] for c in columns] for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(alike, x, y)), (x, y)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
