"""Studies over one table of trials: the same rows however many run at once, resumed, repeated, or partly failed."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trades as T
from tidemark.plans import studies as S

CFG = replace(T.Config(), saldo_inicial=1e4)


class Sometimes:
    """Trades each n-th bar; refuses one value."""

    combinacion_id, name = 97, "sometimes"

    def space(self, chosen):
        from tidemark.plans.strategies import Int

        return {"every": Int(2, 9, 1)}

    def signals(self, bars, params, by=("symbol",)):
        if params["every"] == 5:
            raise ValueError("five is refused")
        return bars.withColumns({"signal_long": F.col("bar_idx") % params["every"] == 0, "signal_short": F.lit(False)})


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = np.random.default_rng(8), []
    for s in ("BTC", "GOLD"):
        close = 50 + np.cumsum(rng.normal(0, 2, 90))
        rows += [(s, i, float(c), float(c + 1), float(c - 1), float(c), 1.0) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, volume double")
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("bar_idx") * 3600).cast("timestamp_ntz")).cache()


def _rows(df):
    return sorted((r.study, r.asset, r.strategy, r.exit_type, r.batch, r.trial, r.state, r.score, sorted(r.params.items())) for r in df.collect())


def test_one_or_four_at_once_and_resumed(spark, bars, tmp_path):
    things = S.quantities(S.assets("btc, gold"), {"BTC": 0.5}, {}).values()
    plan = S.studies_of(things, [Sometimes()], replace(CFG, exit_type="pnl_fixed"))
    one = _rows(S.run_studies(bars, plan, 2, str(tmp_path / "one"), at_once=1, batch=1, sampler="random"))
    four = _rows(S.run_studies(bars, plan, 2, str(tmp_path / "four"), at_once=4, batch=1, sampler="random"))
    assert one == four and len(one) == 4 and {r[1] for r in one} == {"BTC", "GOLD"}
    half = str(tmp_path / "half")
    S.run_studies(bars, plan[:1], 1, half, batch=1, sampler="random")
    assert S.read_trials(spark, half).count() == 1
    assert _rows(S.run_studies(bars, plan[:1], 2, half, batch=1, sampler="random")) == [r for r in one if r[0] == plan[0].name]


def test_failed_trials_and_repeated_batches(spark, bars, tmp_path):
    path = str(tmp_path / "table")
    study = S.Study(S.Asset("BTC", 1.0), Sometimes(), CFG)
    given = [{"every": 4}, {"every": 5}, {"every": 1000}]
    S.run_study(bars, study, 3, path, given=given)
    rows = {r.trial: r for r in S.read_trials(spark, path).collect()}
    assert (rows[0].state, rows[1].state, rows[1].score) == ("complete", "failed", S.FAILED)
    assert "five is refused" in rows[1].error and rows[2].state in {"complete", "empty"}
    held = [(study.name, "BTC", "sometimes", "pnl_fixed", 0, i, r.state, r.score, r.params, r.told, r.error) for i, r in sorted(rows.items())]
    S._tell(spark, path, held)
    assert S.read_trials(spark, path).count() == 3
    S.run_study(bars, study, 3, path, given=given)  # nothing is left to do
    assert S.read_trials(spark, path).count() == 3


def test_assets():
    assert S.assets(" sp, ,ndx,Gold ") == ["SP500", "NASDAQ", "GOLD"] and S.assets("") == ["GOLD"] and S.assets(["btc"]) == ["BTC"]
    made = S.quantities(["BTC", "X"], {"BTC": 0.04})
    assert (made["BTC"].qty, made["X"].qty, made["X"].qty_range) == (0.04, 3.0, None)
