"""Search spaces, study tables, chart rules and names that must be as they are."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import bars as B
from tidemark.operators import metrics as M
from tidemark.operators import trades as T
from tidemark.plans import report as R
from tidemark.plans import search as S
from tidemark.plans import strategies as P


def bars(spark, n=160, start=1000.0):
    rows = [("A", i, start + 40 * ((i * 7919) % 23 - 11) / 11 + i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, close double")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("bar_idx") * 3600).cast("timestamp_ntz")
    return df.withColumns({"timestamp": at, "open": F.col("close") - 1, "high": F.col("close") + 3, "low": F.col("close") - 3, "volume": F.lit(10.0)})


def test_sampled_sets_stay_on_their_steps():
    for made in P.discover().values():
        for p in S.sample(made, 40, 3):
            for name, kind in made.space(p).items():
                if isinstance(kind, P.Choice):
                    assert p[name] in kind.values
                else:
                    assert kind.low <= p[name] <= kind.high + 1e-9
                    assert round((p[name] - kind.low) / kind.step, 6) % 1 == 0
    assert P.find(2).space({"sg_window": 5})["sg_poly"].high == 3


def test_studies_of_both_exit_types(spark):
    cfg = T.Config(saldo_inicial=1e4, exit_type="all")
    got = S.studies(bars(spark), [P.find(3)], 2, cfg, extra=S.quantity_space(0.1, 0.2, 0.05), sampler="random").collect()
    assert sorted((r.exit_type, r.trial) for r in got) == [("pnl_fixed", 0), ("pnl_fixed", 1), ("pnl_trailing", 0), ("pnl_trailing", 1)]
    assert all(0.1 <= float(r.params["qty_max_activo"]) <= 0.2 and r.state in ("complete", "empty") for r in got)
    assert all(("exit_trail_act_pct" in r.params) == (r.exit_type == "pnl_trailing") for r in got)


def test_panels(spark):
    df = bars(spark).withColumns({"ma": F.col("close") * 1.001, "z": F.lit(0.0) + F.col("bar_idx") % 5 - 2, "wide": F.col("close") * 3, "nothing": F.lit(float("nan"))})
    assert R.panels(df, ["ma", "z", "wide", "nothing"]) == {"ma": "overlay", "z": "sub", "wide": "sub", "nothing": "sub"}
    assert R.panels(df, ["ma", "z"], {"z": "overlay", "ma": "?"}) == {"ma": "overlay", "z": "overlay"}


def test_levels_and_warmup():
    assert R.levels({"z_wait_hi": 3, "z_score_ob": "2", "lo_z_score": -2, "entry_long": "x", "z_score_window": 20}, "z_score") == {"period": 20, "hi": 2.0, "lo": -2.0, "mid": 0.0}
    assert R.levels({"z_thr": 2}, "z_score") == {}
    assert R.warmup_bars({}) == 1
    assert R.warmup_bars({"__warmup_bars": 0, "A_PERIOD": 9, "b_len": "x"}) == 9
    assert R.warmup_bars({"__warmup_bars": "30", "b_len": 90}) == 30


def test_timeframe_names():
    assert B.timeframes("5, 60,1h , 15m") == ["5m", "1h", "15m"]
    assert B.timeframes(["2h", 60.0]) == ["2h", "1h"]
    assert B.suffix_minutes("2h") == 120
    with pytest.raises(ValueError, match="no timeframe"):
        B.suffix_minutes("soon")


def test_metric_names(spark):
    df = spark.createDataFrame([(3, 0.5, 2.0)], "n_trades int, sharpe double, trades_por_dia double")
    (row,) = df.select(M.metric(df, "Trade_Count").alias("n"), M.annualised(M.metric(df, "SR"), F.col("trades_por_dia")).alias("y")).collect()
    assert row.n == 3 and row.y == pytest.approx(0.5 * (2 * 365.25) ** 0.5)


def test_long_series_take_linear_time(spark):
    df = spark.range(200_000).select(F.lit("A").alias("symbol"), F.col("id").alias("bar_idx"), (F.col("id") % 97).cast("double").alias("close"))
    t = time.time()
    assert I.ewm(df, {"e": F.col("close")}, span=20, least=20).where("e is null").count() == 19
    assert time.time() - t < 60
