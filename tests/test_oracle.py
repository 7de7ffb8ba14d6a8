"""Every engine query against its SQL counterpart on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import queries as Q

DATA = Path("/root/testdata/sf0.001")
NAMES = list(Q.oracle_sql())


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in at) for r in found], key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
