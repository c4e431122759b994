"""Every registered query of the engine against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def by_text(row):
    """Rows in the order of what is not a float, then of coarse floats."""
    return [str(v) for v in row if not isinstance(v, float)], [round(v, 1) + 0.0 for v in row if isinstance(v, float)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=by_text)
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=by_text)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-3) if isinstance(x, float) and y is not None else str(x) == str(y)


def test_every_query_without_an_oracle_is_known():
    assert set(QUERIES) - set(ORACLE_SQL) == {"leveraged_fold", "leverage_stress_grid", "bootstrap_5000", "permutation_5000"}
