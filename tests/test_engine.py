"""Rules by hand, and differential tests against loops on random walks."""

import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import bars as B
from tidemark.operators import metrics as M
from tidemark.operators import trades as T
from tidemark.operators.atr_exits import AtrConfig, atr_settings, pct_exit, pnl_pct
from tidemark.plans import report as R
from tidemark.plans import search as S
from tidemark.plans import strategies as P
from tidemark.sources import bars as src

T0 = datetime(2024, 1, 1)


def frame(spark, ohlc, symbol="A"):
    rows = [(symbol, T0 + timedelta(hours=i), *map(float, r), 1.0, i) for i, r in enumerate(ohlc)]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, bar_idx long")


def walk(n, seed):
    rng = np.random.default_rng(seed)
    close = 50 + np.cumsum(rng.normal(0, 3, n))
    open_ = np.concatenate(([close[0]], close[:-1])) + rng.normal(0, 2, n)
    return np.stack((open_, np.maximum(open_, close) + rng.random(n) * 4, np.minimum(open_, close) - rng.random(n) * 4, close), axis=1)


def one_trade(spark, ohlc, side="long", **cfg):
    bars = frame(spark, ohlc)
    sig = bars.withColumns({"signal_long": (F.col("bar_idx") == 0) & F.lit(side == "long"), "signal_short": (F.col("bar_idx") == 0) & F.lit(side == "short")})
    c = replace(T.Config(), **cfg)  # margin 75, one unit: 20 % are 15 points
    return T.exits(T.position_size(T.candidates(sig), c), bars).collect()


@pytest.mark.parametrize(
    ("ohlc", "side", "cfg", "price", "reason"),
    [
        ([(100, 100, 100, 100), (80, 81, 79, 80), (1, 1, 1, 1)], "long", {}, 80, "SL"),
        ([(100, 100, 100, 100), (100, 120, 80, 100), (1, 1, 1, 1)], "long", {}, 85, "SL"),
        ([(100, 100, 100, 100), (120, 121, 119, 120), (1, 1, 1, 1)], "long", {}, 115, "TP"),
        ([(100, 100, 100, 100), (120, 121, 119, 120), (1, 1, 1, 1)], "short", {}, 120, "SL"),
        ([(100, 100, 100, 100), (101, 110, 100, 105), (1, 1, 1, 1)], "long", {"exit_type": "pnl_trailing"}, 110 - 3.75, "TRAILING_STOP"),
        ([(100, 100, 100, 100), (108, 108.5, 107, 108), (102, 103, 101, 102)], "long", {"exit_type": "pnl_trailing"}, 102, "TRAILING_STOP"),
        ([(100, 100, 100, 100), (101, 102, 99, 101), (101, 103, 100, 102)], "long", {}, 102, "END_OF_DATA"),
    ],
)
def test_exit_rules(spark, ohlc, side, cfg, price, reason):
    (t,) = one_trade(spark, ohlc, side, **cfg)
    assert (t.exit_price, t.tipo_salida) == (pytest.approx(price), reason)


def loop_exit(b, e, long, q, su, s):
    s_ = 1 if long else -1
    p = b[e, 3]
    sl, tp, act, dist = (su * s[k] / 100 / q for k in ("sl_pct", "tp_pct", "trail_act_pct", "trail_dist_pct"))
    best, active = p, False
    for j in range(e + 1, len(b)):
        o, (fav, adv) = b[j, 0], (b[j, 1], b[j, 2]) if long else (b[j, 2], b[j, 1])
        if s_ * adv <= s_ * p - sl:
            return j, (o if s_ * o <= s_ * p - sl else p - s_ * sl), "SL"
        was, best = active, max(best, fav) if long else min(best, fav)
        active = active or s_ * best >= s_ * p + act
        stop = best - s_ * dist
        if s["trailing"] and active and s_ * adv <= s_ * stop:
            return j, (o if was and s_ * o <= s_ * stop else stop), "TRAILING_STOP"
        if s_ * fav >= s_ * p + tp:
            return j, p + s_ * tp, "TP"
    return len(b) - 1, b[-1, 3], "END_OF_DATA"


@pytest.mark.parametrize("kind", ["pnl_fixed", "pnl_trailing"])
def test_exits_and_selection_match_a_loop(spark, kind):
    b, rng = walk(400, 5), np.random.default_rng(2)
    side = rng.choice([0, 0, 0, 1, 2], len(b))
    bars = frame(spark, b)
    sides = spark.createDataFrame([(i, bool(x == 1), bool(x == 2)) for i, x in enumerate(side.tolist())], "bar_idx long, signal_long boolean, signal_short boolean")
    cfg = replace(T.Config(), exit_type=kind, sl_pct=25.0, tp_pct=40.0, saldo_inicial=1e6)
    exited = T.exits(T.position_size(T.candidates(bars.join(sides, "bar_idx")), cfg), bars)
    got = {r.entry_idx: (r.exit_idx, round(r.exit_price, 9), r.tipo_salida) for r in exited.collect()}
    s = T.exit_settings({}, cfg) | {"trailing": kind == "pnl_trailing"}
    want = {i: loop_exit(b, i, side[i] == 1, 1.0, 75.0, s) for i in range(len(b) - 1) if side[i]}
    assert got == {k: (j, round(x, 9), why) for k, (j, x, why) in want.items()}
    for block in (0, 3):
        chosen, free = [], -1
        for i in sorted(want):
            if i > free:
                chosen.append(i)
                free = want[i][0] + block
        assert [r.entry_idx for r in T.nonoverlapping(exited, block_bars=block).orderBy("seq").collect()] == chosen
    done = T.account(T.nonoverlapping(exited), cfg).orderBy("seq").toPandas()
    assert np.allclose(done.saldo_despues - done.saldo_antes, done.pnl_neto)
    assert (done.entry_idx.to_numpy()[1:] > done.exit_idx.to_numpy()[:-1]).all()
    trace = T.trailing_trace(exited, bars).where("hit_reason is not null").select("entry_idx", "bar_idx", "hit_reason").collect()
    assert {r.entry_idx: (r.bar_idx, r.hit_reason) for r in trace} == {k: (j, why) for k, (j, _, why) in want.items() if why != "END_OF_DATA"}


def test_entries(spark):
    bars = frame(spark, [(1, 1, 1, 1)] * 4)
    sig = bars.withColumns({"signal_long": F.col("bar_idx").isin(1, 3), "signal_short": F.col("bar_idx").isin(1, 2)})
    assert [(r.entry_idx, r.type) for r in T.candidates(sig).orderBy("entry_idx").collect()] == [(1, "long"), (2, "short")]


def test_settings_and_size(spark):
    s = T.exit_settings({"exit_sl_pct": -5, "__exit_tp_pct": 0, "exit_trail_act_pct": 10, "exit_trail_dist_pct": 9})
    assert (s["sl_pct"], s["tp_pct"], s["trail_dist_pct"]) == (5, 1, 5)
    bars = frame(spark, [(100, 100, 100, 100)] * 2)
    sig = bars.withColumns({"signal_long": F.lit(True), "signal_short": F.lit(False)})
    (r,) = T.position_size(T.candidates(sig), replace(T.Config(), qty=100.0)).collect()
    assert (r.qty, r.apalancamiento) == (75 * 60 / 100, 60)


def test_account_rules(spark):
    rows = [("A", i, "long", i, i + 1, 100.0, x, 1.0, 75.0, 1.0, 1.0, 60.0) for i, x in ((1, 90.0), (2, 40.0), (3, 200.0))]
    trades = spark.createDataFrame(rows, "symbol string, seq long, type string, entry_idx long, exit_idx long, entry_price double, exit_price double, qty double, saldo_usado double, volumen double, apalancamiento double, duracion_min double")
    cfg = T.Config(saldo_inicial=50.0, saldo_minimo=10.0, comision_pct=0.01, comision_sides=2)
    done = T.account(trades, cfg).orderBy("seq").collect()
    assert [r.saldo_despues for r in done] == [pytest.approx(38.1), 0.0]  # the third trade never happens
    assert done[1].pnl_neto == pytest.approx(-61.4)
    assert T.account(trades, replace(cfg, saldo_inicial=10.0)).count() == 0
    with pytest.raises(ValueError):
        T.account(trades, replace(cfg, saldo_minimo=-1.0))
    only = T.account(trades.where("seq = 3"), T.Config())
    row = M.scored(M.summary(only.withColumns({"entry_time": F.lit(T0).cast("timestamp_ntz"), "exit_time": F.lit(T0).cast("timestamp_ntz")}), T.Config())).collect()[0]
    assert row.profit_factor is None
    assert row.score == pytest.approx(1 + 20 + 0.5 * 100**1.2)


def test_override(spark):
    path = [(100, 101, 99, 100)] * 3 + [(100, 108, 100, 107)] + [(107 + i, 108 + i, 106 + i, 107.5 + i) for i in range(16)]
    bars = frame(spark, path)
    sig = bars.withColumns({"signal_long": F.col("bar_idx") == 0, "signal_short": F.lit(False)})
    exited = T.exits(T.position_size(T.candidates(sig), replace(T.Config(), tp_pct=9.0)), bars)
    (engine,) = exited.collect()
    assert (engine.exit_idx, engine.exit_price) == (3, 106.75)

    def moved(idx, price=math.nan, reason=None):
        return lambda pdf, near: pd.DataFrame({"exit_idx": pdf.entry_idx + idx, "exit_price": price, "tipo_salida": reason})

    (r,) = T.override_exits(exited, bars, moved(15)).collect()
    assert (r.exit_idx, r.exit_price, r.tipo_salida) == (15, path[15][3], "STRATEGY_EXIT")
    assert r.exit_time == T0 + pd.Timedelta(hours=15) and r.sl_distance == pytest.approx(75 * 0.2)
    (r,) = T.override_exits(exited, bars, moved(99, 50.0, "X")).collect()
    assert (r.exit_idx, r.exit_price, r.tipo_salida, r.exit_time) == (19, 50.0, "X", T0 + pd.Timedelta(hours=19))
    none = lambda pdf, near: pd.DataFrame({"exit_idx": [None] * len(pdf), "exit_price": math.nan, "tipo_salida": None})
    assert T.override_exits(exited, bars, none).collect() == [engine]

    def within(pdf, near):  # the slice of the entry, with two bars behind it
        assert near.bar_idx.tolist() == list(range(6))
        return moved(5)(pdf, near)

    assert T.override_exits(exited, bars, within, ahead=2, span=4).collect()[0].exit_idx == 5
    with pytest.raises(Exception, match="after its entry"):
        T.override_exits(exited, bars, moved(0)).collect()


def test_a_strategy_decides_exits_in_a_run(spark):
    class Held:
        combinacion_id, name, bars_ahead = 99, "held", 4

        def space(self, chosen):
            return {}

        def signals(self, df, params, by=("symbol",)):
            return df.withColumns({"signal_long": F.col("bar_idx").isin(0, 1, 7), "signal_short": F.lit(False)})

        def decide_exit(self, candidates, near, params, saldo):
            return pd.DataFrame({"exit_idx": candidates.entry_idx + params["held"], "exit_price": math.nan, "tipo_salida": None})

    bars = frame(spark, [(100, 100, 100, 100.0 + i) for i in range(12)])
    metrics, executed = S.run_trials(bars, Held(), [(0, {"held": 2}), (1, {"held": 3})], replace(T.Config(), saldo_inicial=1e4))
    got = sorted((r.trial, r.entry_idx, r.exit_idx, r.exit_price) for r in executed.collect())
    assert got == [(0, 0, 2, 102.0), (0, 7, 9, 109.0), (1, 0, 3, 103.0), (1, 7, 10, 110.0)]
    assert sorted(r.n_trades for r in metrics.collect()) == [2, 2]


def test_trials_without_trades_report_zeros(spark):
    class Never:
        combinacion_id, name = 98, "never"

        def space(self, chosen):
            return {}

        def signals(self, df, params, by=("symbol",)):
            return df.withColumns({"signal_long": F.lit(False), "signal_short": F.lit(False)})

    (row,) = S.run_trials(frame(spark, [(1, 1, 1, 1)] * 5), Never(), [(0, {})], T.Config())[0].collect()
    assert (row.n_trades, row.roi, row.saldo_actual, row.saldo_min, row.calmar, row.score) == (0, 0.0, 300.0, 300.0, 0.0, 0.0)
    assert row.profit_factor is None and row.racha_ganadora == 0


def test_percent_levels(spark):
    rows = [("long", 100.0, 98.0, 99.0, 97.0), ("long", 100.0, 100.0, 104.0, 99.5), ("short", 100.0, 103.0, 104.0, 99.0), ("short", 100.0, 100.0, 101.0, 96.0), ("long", 100.0, 100.0, 101.0, 99.0)]
    df = spark.createDataFrame(rows, "side string, entry double, o double, h double, l double")
    hit = pct_exit(F.col("entry"), F.col("side"), F.col("o"), F.col("h"), F.col("l"), F.lit(2.0), F.lit(3.0))
    got = [r.x and tuple(r.x) for r in df.select(hit.alias("x")).collect()]
    assert got == [("SL", 98.0), ("TP", 103.0), ("SL", 103.0), ("TP", 97.0), None]
    pnl = [r.p for r in df.select(pnl_pct(F.col("entry"), F.col("h"), F.col("side")).alias("p")).collect()]
    assert pnl == pytest.approx([-1.0, 4.0, -4.0, -1.0, 1.0])
    assert atr_settings({"__exit_atr_period": 0, "exit_sl_atr": -2}) == AtrConfig(atr_period=1, sl_atr=2.0)


def test_indicators_match_pandas(spark):
    b = walk(300, 9)
    df, w = frame(spark, b), B.series()
    c = F.col("close")
    df = I.ewm(df, {"ema": c}, span=20)
    got = df.select("bar_idx", "ema", I.sma(c, w, 20).alias("sma"), I.rolling_std(c, w, 10).alias("sd"), I.alma(c, w, 9).alias("alma"), I.savgol(c, w, 11, 3, 1).alias("sg"), *[v.alias(k) for k, v in I.ols(c, F.col("bar_idx"), w, 30).items()]).orderBy("bar_idx").toPandas()
    s = pd.Series(b[:, 3])
    dot = lambda k: s.rolling(len(k)).apply(lambda x: x @ k, raw=True)
    line = lambda f: s.rolling(30).apply(lambda y: f(np.polyfit(np.arange(30), y, 1), y), raw=True)
    want = {"sma": s.rolling(20).mean(), "ema": s.ewm(span=20).mean(), "sd": s.rolling(10).std(), "alma": dot(I.alma_weights(9)), "sg": dot(I.savgol_weights(11, 3, 1)), "slope": line(lambda p, y: p[0]), "value": line(lambda p, y: p[0] * 29 + p[1]), "r2": line(lambda p, y: np.corrcoef(np.arange(30), y)[0, 1] ** 2)}
    for name, series in want.items():
        assert np.allclose(got[name].astype(float), series, equal_nan=True, atol=1e-8), name


def test_constant_window_has_no_fit(spark):
    df = frame(spark, [(1, 1, 1, 1)] * 6)
    rows = df.select(*[v.alias(k) for k, v in I.ols(F.col("close"), F.col("bar_idx"), B.series(), 4).items()]).collect()
    assert (rows[-1].r2, rows[-1].ser) == (0.0, 0.0)


def test_armed_window_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    z, x = rng.normal(0, 1.5, (2, 600))
    z[rng.integers(0, 600, 20)] = np.nan
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), i, None if math.isnan(a) else float(a), float(c)) for i, (a, c) in enumerate(zip(z, x, strict=True))], "symbol string, timestamp timestamp_ntz, bar_idx long, z double, x double")
    got = P.armed(df, "z", "x", B.series(), ("symbol",), 1.0, 1.0, 3, 10).orderBy("bar_idx").toPandas()
    for side, s in (("long", 1), ("short", -1)):
        until, want = -1, []
        for i in range(600):
            fire = False
            if i >= 10 and not np.isnan([z[i], z[i - 1]]).any():
                if s * z[i - 1] < -1 <= s * z[i]:
                    until = i + 3
                if until >= i and s * x[i - 1] < -1 <= s * x[i] and s * z[i] < 0:
                    fire, until = True, -1
            want.append(fire)
        assert got[f"signal_{side}"].tolist() == want


def test_resampling_is_associative(spark):
    fine = frame(spark, walk(96, 1)).withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(bar_idx) * 5)"))
    a = B.resample(fine, "1 hour").orderBy("timestamp").collect()
    assert a == B.resample(B.resample(fine, "15 minutes"), "1 hour").orderBy("timestamp").collect()
    made = B.generate(fine)
    assert made["1 hour"].count() == 8
    assert B.generate(fine, minutes=15)["1 hour"].count() == 0


def test_sources(spark, tmp_path):
    bars = frame(spark, walk(20, 2))
    for name in ("a.parquet", "a.csv", "a.feather"):
        path = str(tmp_path / name)
        src.write(bars, path)
        src.write(bars.limit(1), path)  # stays
        got = src.normalise(src.read_feather(spark, f"{path}/*") if name.endswith("feather") else src.scan(spark, path))
        assert got.count() == 20
        assert dict(got.dtypes)["timestamp"] == "timestamp_ntz"
    folder = f"file://{tmp_path}/b.feather"
    src.write(bars.repartition(3), folder)
    src.write(bars.limit(7).repartition(2), folder, overwrite=True)
    assert src.read_feather(spark, f"{folder}/*").count() == 7
    assert not [f for f in (tmp_path / "b.feather").iterdir() if f.suffix != ".feather"]
    shape = ", ".join(f"{name} {kind}" for name, kind in bars.dtypes)
    assert src.scan(spark, str(tmp_path / "a.csv"), shape).dtypes == bars.dtypes
    with pytest.raises(ValueError, match="unsupported"):
        src.scan(spark, "x.txt")
    with pytest.raises(ValueError, match="no time column"):
        src.normalise(bars.drop("timestamp"))
    zoned = spark.sql("select timestamp'2024-01-01 00:00:00+00:00' as Date, 1.0d open, 1.0d high, 1.0d low, 1.0d close")
    assert src.normalise(zoned, need_ohlc=True).collect()[0].timestamp == T0
    assert src.bar_path("r", "ndx", "5m").endswith("NASDAQ_ohlcv_5m.parquet")
    plan = src.between(src.scan(spark, str(tmp_path / "a.parquet")), "2024-01-01", "2024-01-02")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert src.resolve(root, "ndx", "5m") is None
    src.write(bars, src.bar_path(str(tmp_path), "ndx", "5m", "csv"))
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert src.resolve(root, "ndx", "5m") == src.bar_path(root, "ndx", "5m", "csv")
        assert [r.fmt for r in src.inventory(spark, root, ["ndx"], ["5m"]).where("present").collect()] == ["csv"]
    reg = src.Registry()
    reg.get_or_load("A", "5m", lambda: bars)
    assert reg.stats() == {"frames": 1, "assets": 1}
    reg.clear("A")


def test_timeframes():
    assert [B.timeframe_suffix(v) for v in (5, "5", "15m", 60, "60m", "1h", "4h", None, "?")] == ["5m", "5m", "15m", "1h", "1h", "1h", "4h", "1h", "1h"]
    assert B.warmup_in(50, "15m", "5m") == 150
    assert B.warmup_in(1, "5m", "1h") == 1


def test_search_finds_better_sets(spark):
    made = P.find(3)
    assert set(P.discover()) == {2, 3, 7, 9, 10, 11}
    with pytest.raises(ValueError, match="taken"):
        P.register(type(made))
    assert S.sample(made, 3, 1) == S.sample(made, 3, 1)
    for p in S.sample(P.find(2), 50, 4):
        assert p["sg_poly"] <= p["sg_window"] - 2
    told = [(p, -abs(p["hl_period"] - 90)) for p in S.sample(made, 60, 5)]
    near = [abs(p["hl_period"] - 90) for p in S.tpe(made, told, 10, 6)]
    assert np.mean(near) < 25
    bars = frame(spark, walk(120, 7))
    best = S.optimise(bars, made, 4, T.Config(saldo_inicial=1e4), batch=2, optimise_exits=False)
    assert len(best) == 4 and best[0][1] >= best[-1][1]
    with pytest.raises(ValueError):
        S.optimise(bars, made, 1, T.Config(), sampler="grid")


def test_reports(spark, tmp_path):
    bars = frame(spark, walk(150, 8))
    metrics, executed = S.run_trials(bars, P.find(3), [(i, {"hl_period": 5 + i}) for i in range(3)], T.Config(saldo_inicial=1e4))
    metrics = metrics.cache()
    assert metrics.count() == 3
    assert S.top_trials(metrics, 2).count() == 2
    assert R.best_trades(executed, metrics, 1).select("trial").distinct().count() == 1
    R.append(metrics, str(tmp_path / "m"), first_trial=True)
    R.append(metrics, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6
    assert R.merged(metrics.select("symbol"), metrics.select("trial")).columns == ["symbol", "trial"]
    assert R.plot_range(bars, "2030-01-01", None).count() == 150
    assert R.panels(bars.withColumns({"near": F.col("close"), "far": F.lit(-900.0)}), ["near", "far"]) == {"near": "overlay", "far": "sub"}
    assert R.warmup_bars({"a_period": 9, "b_len": 20}) == 20
    assert R.levels({"rsi_overbought": 70, "rsi_oversold": 30}, "rsi") == {"hi": 70.0, "lo": 30.0, "mid": 50.0}
    assert R.aligned(bars, bars.withColumn("n", F.lit(math.nan)), ["n"]).where("n is null").count() == 150
    curve = spark.createDataFrame([("A", i, float(e)) for i, e in enumerate((10, 8, 4, 2))], "symbol string, seq long, equity double")
    assert R.before_ruin(bars, curve).count() == 112


def test_streaming_bars(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars

    rows = [("A", T0 + timedelta(minutes=i), float(i % 7), 1.0, i) for i in range(240)]
    ticks = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, price double, size double, k long").select("symbol", "timestamp", "price", "size", F.struct("k").alias("tie"))
    ticks.write.parquet(str(tmp_path / "t"))
    live = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    q = stream_bars(live, "1 hour").writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("bars").selectExpr("cast(timestamp as timestamp_ntz)", "open", "high", "low", "close", "volume").collect()))
    finally:
        q.stop()
    want = sorted(map(tuple, B.ticks_to_bars(ticks, "1 hour").drop("symbol").collect()))
    assert got and got == want[: len(got)]
