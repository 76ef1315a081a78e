"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from speckle.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    def plain(x):
        if x is None or isinstance(x, bool):
            return (x is not None, str(x))
        return (True, float(x)) if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio") else (True, str(x))
    return sorted(names), sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    rel = con.sql(ORACLE[name])
    mine, theirs = rows(df.columns, got), rows(rel.columns, rel.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1]):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x[1], float) and math.isclose(x[1], y[1], abs_tol=2e-5)), (name, a, b)
