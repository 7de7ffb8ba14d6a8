"""Metrics to their last place against SQL, where averages end in ties and accounts are lost within hours."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import numpy as np
import pytest

from tidemark import queries as Q

#: Series that differed before: ties of averages, two accounts lost at once.
SYMBOLS, EACH, SHOWN = 200, 1500, (15, 116, 141, 149, 156)


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    ts = np.datetime64("2024-01-01T00:00:00", "us") + rng.integers(0, 20 * 86400 * 10**6, SYMBOLS * EACH).astype("timedelta64[us]")
    value = np.round(rng.gamma(2.0, 25.0, SYMBOLS * EACH) + 0.01, 2)
    at = [i for k in SHOWN for i in range(k * EACH, (k + 1) * EACH)]
    rows = [(i, 0, f"{'az'[i // EACH % 2 == 0]}{i // EACH:03d}", t, v, None) for i, t, v in zip(at, ts[at].astype(datetime), value[at].tolist(), strict=True)]
    path = f"{tmp_path_factory.mktemp('exact')}/events.parquet"
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string").write.parquet(path)
    return path


def exactly(spark, path, name):
    got = Q.queries()[name](spark, path.rsplit("/", 1)[0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    found = sorted(tuple(r) for r in got.select(*names).collect())
    rows = sorted(want.fetchall())
    assert len(rows) == len(SHOWN)
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
    return found, rows


def test_metrics_empty_to_the_last_place(spark, ticks):
    found, rows = exactly(spark, ticks, "metrics_empty")
    assert found == rows


def test_metrics_summary_to_the_last_place(spark, ticks):
    found, rows = exactly(spark, ticks, "metrics_summary")
    assert found == rows


def test_rounded_takes_the_side_that_the_double_lies_on(spark):
    values = [155.240941925, -24.610413475, 2.5, -0.0, 1.5e300, 0.1234565, 3.0000005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for places in (6, 8):
        got = [r.v for r in Q.rounded(df, places).orderBy("i").collect()]
        want = [duckdb.execute(f"SELECT round(?::DOUBLE, {places}) + 0.0", [v]).fetchone()[0] for v in values]
        assert got == want


def test_summary_reads_its_trades_from_a_checkpoint(spark):
    executed, bars = Q._executed(spark, "/root/testdata/sf0.001", Q.RICH)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    marked = executed.where("seq < 987654321")
    assert "987654321" in plan(marked)
    assert "987654321" not in plan(Q.M.summary(marked, Q.RICH, Q._period(bars)))
