"""Every registered query of the library proper runs, and equals its SQL where it has one."""

import math

import duckdb
import pytest

from seasonlark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert rows
    if name not in SQL:
        return
    out = con.sql(SQL[name])
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in out.fetchall()]
    key = lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else x if not isinstance(x, str) else x) for x in r)
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=lambda r: repr(key(r))), sorted(want, key=lambda r: repr(key(tuple(float(x) if str(type(x)).find("Decimal") > 0 else x for x in r)))), strict=True):
        assert all(same(x, float(y) if str(type(y)).find("Decimal") > 0 else y) for x, y in zip(a, b, strict=True)), (a, b)
