"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

from signalloom import plans
from signalloom.plans.adapters import TABLES

WITHOUT_SQL = {n for n in plans.QUERIES if n not in plans.ORACLES}


def same(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, list | tuple):
        return repr([same(x) for x in v])
    return str(v) if isinstance(v, bool) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({plans.ORACLES[name]})").fetchall()
    rows = got.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(tuple(map(same, r)) for r in rows) == sorted(tuple(map(same, r)) for r in want)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0
