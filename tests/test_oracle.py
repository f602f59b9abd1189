"""Every query with oracle SQL gives the oracle's rows on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.sources.views import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(DATA) / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def shown(v):
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(tuple(shown(r[c]) for c in names) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())
