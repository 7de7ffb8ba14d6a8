"""The engine's query catalogue over the shared tables, and the same results as SQL.

Doubles are rounded to six places on both sides, as the engines sum in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions.scalar import clip, finite, minutes_between, or_zero
from tidemark.operators import bars as B
from tidemark.operators import metrics as M
from tidemark.operators import trades as T
from tidemark.operators.atr_exits import AtrConfig, atr_exits
from tidemark.plans import report as R
from tidemark.plans import search as S
from tidemark.plans.strategies import Choice, armed, discover, find
from tidemark.plans.studies import Asset, run_studies, studies_of
from tidemark.session import cut, shared_folder
from tidemark.sources.bars import between, event_ticks, lineitem_ticks

Query = Callable[[SparkSession, str], DataFrame]
CFG = T.Config()
TRAIL = replace(CFG, exit_type="pnl_trailing")
RUIN = replace(CFG, saldo_inicial=80.0, saldo_minimo=60.0, qty=3.0, comision_sides=2)
#: An account that outlives its trades, so that metrics see many of them.
RICH = replace(CFG, saldo_inicial=20_000.0, saldo_minimo=0.0)
PARAMS = {2: {"sg_window": 11, "sg_poly": 3, "ols_window": 30, "r2_min": 0.3, "z_thr": 1.0}, 3: {"hl_period": 20}, 7: {"z_threshold": 1.0}, 9: {"z_threshold": 1.0}, 10: {"adx_thr": 15.0}, 11: {"z_window": 20, "alma_window": 20, "norm_window": 20, "z_thr": 1.5, "norm_thr": 2.0, "wait_bars": 4}, 0: {}}


#: Money has seven places, so that rounding it to six would meet ties.
MONEY = 8


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """That many places, no negative zero, no NaN.

    The product is rounded, as SQL engines do: Spark's ``round`` takes a double's shortest decimal, which ends in a tie where the double lies beside it.
    """
    unit = F.lit(10.0**places)

    def fixed(c: str) -> Column:
        near = F.round(F.col(c) * unit) / unit
        return F.when(~F.isnan(c), F.when(F.abs(near) < F.lit(float("inf")), near).otherwise(F.col(c)) + F.lit(0.0))

    return df.withColumns({c: fixed(c) for c, t in df.dtypes if t == "double"})


def hourly(s: SparkSession, d: str) -> DataFrame:
    return B.indexed(B.ticks_to_bars(event_ticks(s, d), "1 hour"))


def _with(df: DataFrame, **cols) -> DataFrame:
    return rounded(df.select("symbol", "timestamp", *[c.alias(n) for n, c in cols.items()]))


# Columns and windows need a session, so they are made when a query runs.
w = B.series
C, H, L, V = ((lambda name=name: F.col(name)) for name in ("close", "high", "low", "volume"))


def _indicator(make: Callable[[], dict]) -> Query:
    return lambda s, d: _with(hourly(s, d), **make())


def _signals(key: int, shown: tuple[str, ...]) -> Query:
    return lambda s, d: rounded(find(key).signals(hourly(s, d), PARAMS[key]).select("symbol", "bar_idx", *shown, "signal_long", "signal_short"))


def _entries(s: SparkSession, d: str, cfg: T.Config = CFG) -> tuple[DataFrame, DataFrame]:
    bars = cut(hourly(s, d))  # bars are few beside the ticks behind them, and every step from here reads them
    return T.position_size(T.candidates(find(3).signals(bars, PARAMS[3])), cfg), bars


def _exited(s: SparkSession, d: str, cfg: T.Config = CFG) -> tuple[DataFrame, DataFrame]:
    sized, bars = _entries(s, d, cfg)
    return T.exits(sized, bars), bars


def _executed(s: SparkSession, d: str, cfg: T.Config = CFG) -> tuple[DataFrame, DataFrame]:
    exited, bars = _exited(s, d, cfg)
    return T.account(T.nonoverlapping(exited, block_bars=cfg.block_bars), cfg), bars


EXIT_COLS = ("symbol", "type", "entry_idx", "exit_idx", "entry_price", "exit_price", "tipo_salida", "sl_distance")
EXEC_COLS = ("symbol", "seq", "entry_idx", "exit_idx", "pnl", "comision", "pnl_neto", "pnl_pct", "saldo_antes", "saldo_despues", "saldo_usado", "volumen", "apalancamiento", "duracion_min")
SUMMARY_COLS = ("roi", "winrate", "expectativa", "retorno_promedio", "sqn", "estabilidad", "racha_ganadora", "racha_perdedora", "porc_ganadoras", "porc_perdedoras", "trades_por_dia", "pnl_neto_por_dia_operado", "n_trades", "n_trades_long", "n_trades_short", "riesgo_beneficio", "payoff_ratio", "sharpe", "sortino", "profit_factor", "calmar", "drawdown", "saldo_actual", "saldo_min", "saldo_max", "saldo_mean", "max_ganancia", "max_perdida", "duration_mean_min", "comisiones_total", "saldo_sin_comisiones", "pnl_neto")


def _period(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("timestamp").alias("period_start"), F.max("timestamp").alias("period_end"))


def metrics_summary(s: SparkSession, d: str, cfg: T.Config = CFG) -> DataFrame:
    executed, bars = _executed(s, d, cfg)
    return rounded(M.summary(executed, cfg, _period(bars)).select("symbol", *SUMMARY_COLS), MONEY)


def _scores(s: SparkSession, d: str, cfg: T.Config = CFG) -> DataFrame:
    executed, bars = _executed(s, d, cfg)
    return rounded(M.scored(M.summary(executed, cfg, _period(bars))).select("symbol", "score"), MONEY)


#: Trials of the sweep queries: number, length of the average, stop and target in percent.
TRIALS = ((0, 20, 20.0, 20.0), (1, 20, 15.0, 40.0), (2, 35, 20.0, 20.0), (3, 50, 30.0, 30.0))


def sweep(s: SparkSession, d: str) -> DataFrame:
    trials = [(n, {"hl_period": k, "exit_sl_pct": sl, "exit_tp_pct": tp}) for n, k, sl, tp in TRIALS]
    return S.run_trials(hourly(s, d), find(3), trials, CFG)[0]


#: Assets of the study query, and its two parameter sets: length of the average, stop and target in percent.
STUDIED, GIVEN = ("click", "purchase"), ((20, 20.0, 20.0), (35, 15.0, 40.0))


def _trials(s: SparkSession, d: str) -> DataFrame:
    """Four studies, two assets by two exit types, of given parameter sets, run at once over one table of trials."""
    bars = cut(hourly(s, d))
    plan = studies_of([Asset(a, CFG.qty) for a in STUDIED], [find(3)], replace(CFG, exit_type="all"))
    given = [{"hl_period": k, "exit_sl_pct": sl, "exit_tp_pct": tp} for k, sl, tp in GIVEN]
    table = run_studies(bars, plan, len(given), f"{shared_folder(s)}/trials-{uuid.uuid4().hex}", given=given)
    return rounded(table.select("study", "asset", "strategy", "exit_type", "trial", "state", "score"))


def _asof(mode: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        ticks = event_ticks(s, d)
        base = B.ticks_to_bars(ticks, "15 minutes").select("symbol", "timestamp", "close")
        up = B.ticks_to_bars(ticks, "1 hour").select("symbol", "timestamp", (C() > F.col("open")).alias("signal_long"), F.col("close").alias("close_1h"))
        return rounded(B.asof_align(base, up, ["signal_long", "close_1h"], mode))

    return run


def _nearest(s: SparkSession, d: str) -> DataFrame:
    ticks = event_ticks(s, d)
    points = ticks.select("symbol", "timestamp", F.col("tie.event_id").alias("event_id"))
    return B.nearest(points, B.ticks_to_bars(ticks, "1 hour"), "event_id")


def _armed(s: SparkSession, d: str) -> DataFrame:
    df = hourly(s, d).withColumns({"z": I.zscore(C(), w(), 20), "x": I.zscore(C(), w(), 10)})
    return armed(df, "z", "x", w(), ("symbol",), 1.0, 1.0, 3, 25).select("symbol", "bar_idx", "signal_long", "signal_short")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return hourly(s, d).withColumn("raw", C() > I.sma(C(), w(), 5)).select("symbol", "bar_idx", I.rising_edge(F.col("raw"), w()).alias("edge"))


def _crosses(s: SparkSession, d: str) -> DataFrame:
    df = hourly(s, d)
    kinds = {"up_strict": ("<", ">"), "up_ge": ("<", ">="), "up_le": ("<=", ">"), "down_strict": (">", "<"), "down_le": (">", "<="), "down_ge": (">=", "<")}
    return df.select("symbol", "bar_idx", *[I.cross(C(), 50.0, w(), a, b).alias(n) for n, (a, b) in kinds.items()])


def _nulls(s: SparkSession, d: str) -> DataFrame:
    """Clipping, finite filters and null replacement on warm-up columns."""
    df = hourly(s, d).withColumns({"z": I.zscore(C(), w(), 20)})
    return rounded(df.select("symbol", "bar_idx", clip(F.col("z"), -1.0, 1.0).alias("clipped"), or_zero(F.col("z")).alias("zeroed"), finite(F.col("z")).alias("is_finite"), F.coalesce(F.col("z") > 0, F.lit(False)).alias("filled")))


def _trace(s: SparkSession, d: str) -> DataFrame:
    exited, bars = _exited(s, d, TRAIL)
    return rounded(T.trailing_trace(exited, bars).drop("timestamp", "sl_pct", "tp_pct", "trail_act_pct", "trail_dist_pct", "stake"))


WIDE = replace(CFG, sl_pct=90.0, tp_pct=90.0)
ATR_FIXED, ATR_TRAIL = AtrConfig(tp_atr=3.0, sl_atr=1.5), AtrConfig("atr_trailing")


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Stops so wide that trades stay open over thousands of one-minute bars, many to the end."""
    bars = cut(B.indexed(B.ticks_to_bars(event_ticks(s, d).withColumn("symbol", F.lit("all")), "1 minute")))
    sized = T.position_size(T.candidates(find(3).signals(bars, PARAMS[3])), WIDE)
    return rounded(T.exits(sized, bars).select(*EXIT_COLS))


def _atr_exited(cfg: AtrConfig) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        bars = cut(hourly(s, d))
        done = atr_exits(T.candidates(find(3).signals(bars, PARAMS[3])), bars, cfg)
        return rounded(done.select("symbol", "type", "entry_idx", "exit_idx", "entry_price", "exit_price", "tipo_salida"))

    return run


def _close_beyond(candidates: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
    """Leave at the first of eight bars that closes beyond the entry bar's far side."""
    at = bars["bar_idx"].to_numpy()
    close, low, high = (bars[c].to_numpy() for c in ("close", "low", "high"))
    found = []
    for entry, side in zip(candidates["entry_idx"], candidates["type"], strict=True):
        i = int(at.searchsorted(entry))
        near = close[i + 1 : i + 9]
        beyond = (near < low[i] if side == "long" else near > high[i]).nonzero()[0]
        found.append(at[i + 1 + beyond[0]] if len(beyond) else None)
    return pd.DataFrame({"exit_idx": pd.array(found, "Int64"), "exit_price": None, "tipo_salida": None})


def _overridden(s: SparkSession, d: str) -> DataFrame:
    exited, bars = _exited(s, d)
    own = T.override_exits(exited, bars, _close_beyond, ahead=8, span=256)
    return rounded(own.select(*EXIT_COLS, minutes_between(F.col("entry_time"), F.col("exit_time")).alias("minutes")))


def _empty(s: SparkSession, d: str) -> DataFrame:
    """Metrics of every symbol where only those up to "m" traded."""
    executed, bars = _executed(s, d)
    made = M.summary(executed.where(F.col("symbol") < "m"), CFG, _period(bars))
    every = bars.select("symbol").distinct()
    return rounded(M.with_empty(made, every, CFG).select("symbol", *SUMMARY_COLS), MONEY)


def _streaks(s: SparkSession, d: str) -> DataFrame:
    return M.streaks(_executed(s, d)[0])


def _longest(s: SparkSession, d: str) -> DataFrame:
    return rounded(R.longest_trade(_executed(s, d)[0].select("symbol", "entry_idx", "exit_idx", "duracion_min"), "symbol"))


def queries() -> dict[str, Query]:
    daily = lambda s, d: B.ticks_to_bars(lineitem_ticks(s, d), "1 day")
    found: dict[str, Query] = {
        "bars_1h": lambda s, d: rounded(hourly(s, d)),
        "bars_15m": lambda s, d: rounded(B.ticks_to_bars(event_ticks(s, d), "15 minutes")),
        "bars_daily_lineitem": daily,
        "resample_15m_to_1h": lambda s, d: rounded(B.resample(B.ticks_to_bars(event_ticks(s, d), "15 minutes"), "1 hour")),
        "date_filter": lambda s, d: between(event_ticks(s, d), "2024-01-05", "2024-01-10").select("symbol", "timestamp", "price"),
        "audit": lambda s, d: B.audit(B.ticks_to_bars(event_ticks(s, d), "15 minutes"), 900),
        "median_delta_check": lambda s, d: B.median_step(B.ticks_to_bars(event_ticks(s, d), "1 hour"), 3600),
        "asof_align_ref": _asof("reference"),
        "asof_align_safe": _asof("safe"),
        "nearest_snap": _nearest,
        "dedup_ts": lambda s, d: B.dedup(event_ticks(s, d).withColumn("timestamp", F.date_trunc("minute", "timestamp").cast("timestamp_ntz")), F.col("tie")).select("symbol", "timestamp", F.col("tie.event_id").alias("event_id")),
        "null_handling": _nulls,
        "sma": _indicator(lambda: {"sma20": I.sma(C(), w(), 20), "sma3_min1": I.sma(C(), w(), 3, 1)}),
        "rolling_std": _indicator(lambda: {"std20": I.rolling_std(C(), w(), 20)}),
        "rolling_minmax": _indicator(lambda: {"lo20": I.rolling_min(C(), w(), 20), "hi20": I.rolling_max(C(), w(), 20)}),
        "shift_diff": _indicator(lambda: {"prev": I.prev(C(), w()), "diff": I.diff(C(), w())}),
        "zscore": _indicator(lambda: {"z": I.zscore(C(), w(), 20)}),
        "rsi": lambda s, d: _with(hourly(s, d), rsi=I.rsi(C(), w(), 14)),
        "true_range": _indicator(lambda: {"tr": I.true_range(H(), L(), C(), w()), "plus_dm": I.directional_moves(H(), L(), w())[0], "minus_dm": I.directional_moves(H(), L(), w())[1]}),
        "ema_span": lambda s, d: _with(I.ewm(hourly(s, d), {"e": C()}, span=20), ema=F.col("e")),
        "ema_alpha": lambda s, d: _with(I.ewm(hourly(s, d), {"e": C()}, alpha=0.1, least=10), ema=F.col("e")),
        "adx": lambda s, d: _with(I.adx(hourly(s, d), 14, 14), adx=F.col("adx")),
        "zscore_ema": lambda s, d: _with(I.ewm(hourly(s, d), {"e": C()}, span=20, least=20), z=I.zscore(F.col("e"), w(), 30)),
        "alma": _indicator(lambda: {"alma": I.alma(C(), w(), 9)}),
        "linreg_value": _indicator(lambda: {"linreg": I.ols(C(), F.col("bar_idx"), w(), 30)["value"]}),
        "linreg_slope": _indicator(lambda: {"slope": I.ols(C(), F.col("bar_idx"), w(), 30)["slope"]}),
        "rolling_ols": _indicator(lambda: {k: v for k, v in I.ols(C(), F.col("bar_idx"), w(), 30).items() if k in ("slope", "r2", "ser", "value")}),
        "norm_price": _indicator(lambda: {"norm": I.norm_price(C(), w(), 20)}),
        "norm_volume": lambda s, d: _with(hourly(s, d).withColumn("v", I.sma(V(), w(), 3, 1)), norm=I.norm_volume(F.col("v"), w(), 20)),
        "norm_residual": lambda s, d: _with(hourly(s, d).withColumn("g", C() - I.alma(C(), w(), 9)), norm=I.norm_residual(F.col("g"), w(), 20)),
        "cross_variants": _crosses,
        "rising_edge": _edges,
        "armed_window": _armed,
        "signals_s0": _signals(0, ("rsi",)),
        "signals_s2": _signals(2, ("p_smooth", "velocity", "acceleration", "beta", "r2")),
        "signals_s3": _signals(3, ("ma_hl",)),
        "signals_s7": _signals(7, ("z_score", "linreg")),
        "signals_s9": _signals(9, ("z_score", "linreg_slope")),
        "signals_s10": _signals(10, ("adx", "fusion_signal")),
        "signals_s11": _signals(11, ("z_score", "alma", "norm_price")),
        "position_size": lambda s, d: rounded(_entries(s, d, replace(CFG, qty=100.0))[0].select("symbol", "entry_idx", "type", "entry_price", "saldo_usado", "qty", "volumen", "apalancamiento")),
        "exit_fixed": lambda s, d: rounded(_exited(s, d)[0].select(*EXIT_COLS)),
        "exit_trailing": lambda s, d: rounded(_exited(s, d, TRAIL)[0].select(*EXIT_COLS)),
        "trailing_trace": _trace,
        "exit_wide": _wide,
        "exit_override": _overridden,
        "exit_atr_fixed": _atr_exited(ATR_FIXED),
        "exit_atr_trailing": _atr_exited(ATR_TRAIL),
        "atr_wilder": lambda s, d: _with(I.atr_wilder(hourly(s, d), 14), atr=F.col("atr")),
        "metrics_empty": _empty,
        "trades_nonoverlap": lambda s, d: T.nonoverlapping(_exited(s, d)[0]).select("symbol", "seq", "entry_idx", "exit_idx"),
        "trades_cooldown": lambda s, d: T.nonoverlapping(_exited(s, d)[0], block_bars=5).select("symbol", "seq", "entry_idx", "exit_idx"),
        "account_sim": lambda s, d: rounded(_executed(s, d)[0].select(*EXEC_COLS), MONEY),
        "account_ruin": lambda s, d: rounded(_executed(s, d, RUIN)[0].select(*EXEC_COLS), MONEY),
        "account_long": lambda s, d: rounded(_executed(s, d, RICH)[0].select(*EXEC_COLS), MONEY),
        "metrics_long": lambda s, d: metrics_summary(s, d, RICH),
        "score_long": lambda s, d: _scores(s, d, RICH),
        "equity_drawdown": lambda s, d: rounded(T.equity(_executed(s, d)[0], CFG).drop("delta"), MONEY),
        "streaks": _streaks,
        "longest_trade": _longest,
        "metrics_summary": metrics_summary,
        "score": _scores,
        "sweep_topk": lambda s, d: rounded(S.best_of_each(sweep(s, d), 2, "symbol").select("symbol", F.col("trial"), "n_trades", "score", F.col("rank").cast("long").alias("rank"))),
        "trials_table": _trials,
        "best_so_far": lambda s, d: rounded(S.best_so_far(sweep(s, d), "symbol").select("symbol", "trial", "score", "best_score")),
        "summary_table": lambda s, d: R.summary_table(sweep(s, d).select("symbol", "trial", "n_trades", "saldo_actual", "score"), "crossover_hl_ma", 4),
        "chart_candles": lambda s, d: R.candles(hourly(s, d)),
        "chart_markers": lambda s, d: rounded(R.markers(*_executed(s, d), warmup=20)),
    }
    for deriv in (0, 1, 2):
        found[f"savgol_{deriv}"] = _indicator(lambda deriv=deriv: {"sg": I.savgol(C(), w(), 11, 3, deriv)})
    return found


# --- the same in SQL -------------------------------------------------------

_W = "PARTITION BY symbol ORDER BY timestamp"


def _rows(k: int) -> str:
    return f"({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _guard(x: str, k: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_rows(k)} >= {k} THEN {value} OVER {_rows(k)} END"


def _r(x: str, places: int = 6) -> str:
    return f"CASE WHEN NOT isnan(({x})::DOUBLE) THEN round(({x})::DOUBLE, {places}) + 0.0 END"


_TICKS = "ticks AS (SELECT event_type AS symbol, ts AS timestamp, value AS price, 1.0::DOUBLE AS size, event_id AS tie FROM events)"


def _bars(name: str, width: str, ticks: str = "ticks") -> str:
    return f"{name} AS (SELECT symbol, time_bucket(INTERVAL '{width}', timestamp) AS timestamp, arg_min(price, (timestamp, tie)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (timestamp, tie)) AS close, sum(size) AS volume FROM {ticks} GROUP BY ALL)"


_BASE = f"WITH RECURSIVE {_TICKS}, {_bars('b0', '1 hour')}, b AS (SELECT *, row_number() OVER ({_W}) - 1 AS bar_idx FROM b0)"


def _select(cols: dict[str, str], extra: str = "", source: str = "b", keys: str = "symbol, timestamp") -> str:
    return f"{_BASE}{extra} SELECT {keys}, " + ", ".join(f"{_r(v)} AS {k}" for k, v in cols.items()) + f" FROM {source}"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _z(x: str, k: int) -> str:
    return _div(f"{x} - {_guard(x, k, f'avg({x})')}", _guard(x, k, f"stddev_samp({x})"))


def _ewm_cte(name: str, source: str, x: str, alpha: float, least: int) -> str:
    """Weights (1 - alpha) ** distance over all earlier rows, in terms of the values that are there."""
    seen = f"(SELECT *, count({x}) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS seen FROM {source})"
    return f"""{name} AS (SELECT i.symbol, i.timestamp, i.bar_idx, CASE WHEN i.seen >= {least} AND i.{x} IS NOT NULL THEN sum(j.{x} * power({1 - alpha!r}, i.bar_idx - j.bar_idx)) / sum(power({1 - alpha!r}, i.bar_idx - j.bar_idx)) END AS v
    FROM {seen} i JOIN {source} j ON i.symbol = j.symbol AND j.bar_idx <= i.bar_idx AND j.{x} IS NOT NULL GROUP BY i.symbol, i.timestamp, i.bar_idx, i.seen, i.{x})"""


def _dot(x: str, weights) -> str:
    k = len(weights)
    terms = " + ".join(f"lag({x}, {k - 1 - i}) OVER ({_W}) * ({float(v)!r})" for i, v in enumerate(weights))
    return f"({terms})"


def _ols(y: str, k: int) -> dict[str, str]:
    regr = lambda f: _guard(y, k, f"{f}({y}, bar_idx)")
    syy, r2 = regr("regr_syy"), regr("regr_r2")
    return {"slope": regr("regr_slope"), "value": f"{regr('regr_intercept')} + {regr('regr_slope')} * bar_idx", "r2": f"CASE WHEN {syy} = 0 THEN 0.0 ELSE {r2} END", "ser": f"CASE WHEN {syy} IS NULL THEN NULL WHEN {syy} = 0 THEN 0.0 ELSE sqrt(greatest({syy} * (1 - {r2}), 0) / {k - 2}) END"}


def _lag(x: str) -> str:
    return f"lag({x}) OVER ({_W})"


_DM = f"""m AS (SELECT *, greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) AS tr,
    CASE WHEN high - {_lag('high')} > {_lag('low')} - low AND high - {_lag('high')} > 0 THEN high - {_lag('high')} ELSE 0.0 END AS pdm,
    CASE WHEN {_lag('low')} - low > high - {_lag('high')} AND {_lag('low')} - low > 0 THEN {_lag('low')} - low ELSE 0.0 END AS mdm FROM b)"""


def _adx(length: int, smooth: int) -> str:
    parts = ", ".join(_ewm_cte(f"e_{x}", "m", x, 1.0 / length, length) for x in ("tr", "pdm", "mdm"))
    di = "SELECT t.symbol, t.timestamp, t.bar_idx, p.v / nullif(t.v, 0) * 100 AS dp, q.v / nullif(t.v, 0) * 100 AS dm FROM e_tr t JOIN e_pdm p USING (symbol, bar_idx) JOIN e_mdm q USING (symbol, bar_idx)"
    return f"{_DM}, {parts}, di AS ({di}), dxs AS (SELECT symbol, timestamp, bar_idx, abs(dp - dm) / nullif(dp + dm, 0) * 100 AS dx FROM di), {_ewm_cte('adx0', 'dxs', 'dx', 1.0 / smooth, smooth)}, adx AS (SELECT d.symbol, d.timestamp, d.bar_idx, a.v AS adx FROM dxs d LEFT JOIN adx0 a USING (symbol, bar_idx))"


def _norm_price(k: int, x: str = "close") -> str:
    lo, hi = _guard(x, k, f"min({x})"), _guard(x, k, f"max({x})")
    return f"-2.0 + ({x} - {lo}) * 4.0 / (CASE WHEN {hi} - {lo} = 0 THEN 1.0 ELSE {hi} - {lo} END)"


def _norm_volume(k: int) -> str:
    lo, hi = _guard("v", k, "min(v)"), _guard("v", k, "max(v)")
    return f"coalesce(0.5 + (v - {lo}) / (CASE WHEN {hi} - {lo} = 0 THEN 1.0 ELSE {hi} - {lo} END), 1.0)"


_V3 = f"vs AS (SELECT *, avg(volume) OVER {_rows(3)} AS v FROM b)"


def _truth(cols: dict[str, str], source: str, extra: str, shown: dict[str, str]) -> str:
    values = ", ".join(f"{_r(v)} AS {k}" for k, v in shown.items())
    return f"{_BASE}{extra} SELECT symbol, bar_idx{', ' + values if values else ''}, " + ", ".join(f"coalesce({v}, false) AS {k}" for k, v in cols.items()) + f" FROM {source}"


def _up(x: str, level: str, a: str, b: str) -> str:
    return f"(p_{x} {a} {level} AND {x} {b} {level})"


def _lagged(name: str, source: str, *cols: str) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f"lag({c}) OVER ({_W}) AS p_{c}" for c in cols) + f" FROM {source})"


def _armed_sql(source: str, z: str, x: str, z_thr: float, x_thr: float, wait: int, warmup: int) -> str:
    """Windows as in the engine: the last arming before, then the first firing of each arming."""
    live = f"bar_idx >= {warmup} AND {z} IS NOT NULL AND p_{z} IS NOT NULL AND {x} IS NOT NULL AND p_{x} IS NOT NULL"
    out = [_lagged("a0", source, z, x)]
    prev = "a0"
    for side, s in (("long", ""), ("short", "-")):
        arm = f"{live} AND {s}p_{z} < -{z_thr} AND {s}{z} >= -{z_thr}"
        fire = f"{live} AND {s}p_{x} < -{x_thr} AND {s}{x} >= -{x_thr} AND {s}{z} < 0"
        out.append(f"a_{side} AS (SELECT *, max(CASE WHEN {arm} THEN bar_idx END) OVER ({_W}) AS arm_{side}, coalesce({fire}, false) AS hit_{side} FROM {prev})")
        out.append(f"f_{side} AS (SELECT *, coalesce(hit_{side} AND bar_idx - arm_{side} <= {wait}, false) AS fire_{side} FROM a_{side})")
        out.append(f"s_{side} AS (SELECT *, fire_{side} AND sum(fire_{side}::INT) OVER (PARTITION BY symbol, arm_{side} ORDER BY bar_idx) = 1 AS signal_{side} FROM f_{side})")
        prev = f"s_{side}"
    return ", ".join(out)


def _z_ema(ema: int, lookback: int) -> str:
    std = _guard("e", lookback, "stddev_samp(e)")
    return f"{_ewm_cte('em', 'b', 'close', 2.0 / (ema + 1), ema)}, ze AS (SELECT b.*, em.v AS e FROM b JOIN em USING (symbol, bar_idx)), zs AS (SELECT *, CASE WHEN {std} = 0 THEN 0.0 ELSE {_z('e', lookback)} END AS z FROM ze)"


def _s3(k: int, name: str = "sig") -> str:
    """Signals of the midpoint crossover."""
    return f"""{name}_0 AS (SELECT *, {_guard('(high + low) / 2.0', k, 'avg((high + low) / 2.0)')} AS ma_hl FROM b), {_lagged(name + '_1', name + '_0', 'close', 'ma_hl')},
    {name} AS (SELECT *, coalesce(p_close < p_ma_hl AND close > ma_hl, false) AS signal_long, coalesce(p_close > p_ma_hl AND close < ma_hl, false) AS signal_short FROM {name}_1)"""


def _c0_sql(k: int = 20, tag: str = "") -> str:
    """Candidates: the signal bars of the crossover but each series' last bar."""
    return f"""{_s3(k, 'sig' + tag)}, c0{tag} AS (SELECT symbol, CASE WHEN signal_long THEN 'long' ELSE 'short' END AS type, CASE WHEN signal_long THEN 1.0 ELSE -1.0 END AS sg, bar_idx AS entry_idx, timestamp AS entry_time, close AS entry_price, end_idx
    FROM (SELECT *, max(bar_idx) OVER (PARTITION BY symbol) AS end_idx FROM sig{tag}) WHERE (signal_long OR signal_short) AND bar_idx < end_idx)"""


def _exit_sql(cfg: T.Config, k: int = 20, tag: str = "", sl: float | None = None, tp: float | None = None) -> str:
    """Candidates and their exits: every later bar of every candidate with its running best, then the first hit."""
    margin, trailing = min(cfg.saldo_usado, cfg.saldo_inicial), cfg.exit_type == "pnl_trailing"
    sl, tp = sl or cfg.sl_pct, tp or cfg.tp_pct
    act, dist = cfg.trail_act_pct, min(cfg.trail_dist_pct, cfg.trail_act_pct / 2)
    trail = "best >= act AND adv <= best - dist" if trailing else "false"
    return f"""{_c0_sql(k, tag)},
    c1{tag} AS (SELECT *, {margin}::DOUBLE AS saldo_usado, greatest(1.0, least({cfg.qty} * entry_price / {margin}, {cfg.apalancamiento_max})) AS apalancamiento, CASE WHEN {cfg.qty} * entry_price / {margin} > {cfg.apalancamiento_max} THEN {margin} * {cfg.apalancamiento_max} / entry_price ELSE {cfg.qty}::DOUBLE END AS qty FROM c0{tag}),
    c2{tag} AS (SELECT *, qty * entry_price AS volumen, saldo_usado * {sl / 100!r} / qty AS sl_distance, sg * entry_price AS s_entry, sg * entry_price - saldo_usado * {sl / 100!r} / qty AS sl, sg * entry_price + saldo_usado * {tp / 100!r} / qty AS tp, sg * entry_price + saldo_usado * {act / 100!r} / qty AS act, saldo_usado * {dist / 100!r} / qty AS dist FROM c1{tag}),
    h0{tag} AS (SELECT c.*, b.bar_idx, b.timestamp, b.open AS o, b.high AS h, b.low AS l, b.close AS cl, sg * b.open AS so, CASE WHEN sg > 0 THEN b.high ELSE -b.low END AS fav, CASE WHEN sg > 0 THEN b.low ELSE -b.high END AS adv FROM c2{tag} c JOIN b ON b.symbol = c.symbol AND b.bar_idx > c.entry_idx),
    h1{tag} AS (SELECT *, greatest(s_entry, max(fav) OVER (PARTITION BY symbol, entry_idx ORDER BY bar_idx)) AS best, coalesce(greatest(s_entry, max(fav) OVER (PARTITION BY symbol, entry_idx ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s_entry) AS best0 FROM h0{tag}),
    h2{tag} AS (SELECT *, CASE WHEN adv <= sl THEN 'SL' WHEN {trail} THEN 'TRAILING_STOP' WHEN fav >= tp THEN 'TP' END AS hit, sg * CASE WHEN adv <= sl THEN least(so, sl) WHEN {trail} THEN CASE WHEN best0 >= act THEN least(so, best - dist) ELSE best - dist END WHEN fav >= tp THEN tp END AS price FROM h1{tag}),
    f{tag} AS (SELECT symbol, entry_idx, min(bar_idx) AS exit_idx, arg_min(hit, bar_idx) AS hit, arg_min(price, bar_idx) AS price, arg_min(timestamp, bar_idx) AS at FROM h2{tag} WHERE hit IS NOT NULL GROUP BY ALL),
    x{tag} AS (SELECT c.*, coalesce(f.exit_idx, c.end_idx) AS exit_idx, coalesce(f.price, z.close) AS exit_price, coalesce(f.at, z.timestamp) AS exit_time, coalesce(f.hit, 'END_OF_DATA') AS tipo_salida FROM c2{tag} c LEFT JOIN f{tag} f USING (symbol, entry_idx) JOIN b z ON z.symbol = c.symbol AND z.bar_idx = c.end_idx)"""


def _minute_sql() -> str:
    """Bars of one minute over all events as one series, long enough for three levels of blocks."""
    ticks = "ticks AS (SELECT 'all' AS symbol, ts AS timestamp, value AS price, 1.0::DOUBLE AS size, event_id AS tie FROM events)"
    return f"WITH RECURSIVE {ticks}, {_bars('b0', '1 minute')}, b AS (SELECT *, row_number() OVER ({_W}) - 1 AS bar_idx FROM b0)"


def _atr_sql(p: int) -> str:
    """Wilder's range in closed form: the seed and each later true range by its weight."""
    m = (p - 1) / p
    return f"""{_DM}, seeds AS (SELECT symbol, avg(tr) AS seed FROM m WHERE bar_idx < {p} GROUP BY symbol),
    atr AS (SELECT i.symbol, i.timestamp, i.bar_idx, CASE WHEN i.bar_idx >= {p - 1} THEN any_value(seed) * power({m!r}, i.bar_idx - {p - 1}) + coalesce(sum(j.tr / {p} * power({m!r}, i.bar_idx - j.bar_idx)) FILTER (j.bar_idx >= {p}), 0) END AS atr
      FROM m i JOIN m j ON i.symbol = j.symbol AND j.bar_idx <= i.bar_idx JOIN seeds s ON s.symbol = i.symbol GROUP BY i.symbol, i.timestamp, i.bar_idx)"""


def _atr_exit_sql(cfg: AtrConfig) -> str:
    trailing = cfg.exit_type == "atr_trailing"
    stop = cfg.emergency_sl_atr_mult if trailing else cfg.sl_atr
    first, second = ("SL_EMERGENCY", "adv <= stop THEN 'TRAILING_STOP'") if trailing else ("SL", "fav >= tp THEN 'TP'")
    price = "adv <= stop THEN least(so, stop)" if trailing else "fav >= tp THEN tp"
    return f"""{_c0_sql()}, {_atr_sql(cfg.atr_period)}, ab AS (SELECT b.*, CASE WHEN atr > 0 THEN atr ELSE greatest(high - low, close * 0.001) END AS rg FROM b JOIN atr USING (symbol, bar_idx)),
    c1 AS (SELECT c0.*, rg AS w, sg * entry_price - rg * {stop} AS sl, sg * entry_price + rg * {cfg.tp_atr} AS tp FROM c0 JOIN ab ON ab.symbol = c0.symbol AND ab.bar_idx = c0.entry_idx),
    h0 AS (SELECT c.*, ab.bar_idx, ab.timestamp, sg * ab.open AS so, CASE WHEN sg > 0 THEN ab.high ELSE -ab.low END AS fav, CASE WHEN sg > 0 THEN ab.low ELSE -ab.high END AS adv, sg * ab.close - {cfg.trailing_atr_mult} * ab.rg AS g FROM c1 c JOIN ab ON ab.symbol = c.symbol AND ab.bar_idx > c.entry_idx),
    h1 AS (SELECT *, greatest(sl - w, max(g) OVER (PARTITION BY symbol, entry_idx ORDER BY bar_idx)) AS stop FROM h0),
    h2 AS (SELECT *, CASE WHEN adv <= sl THEN '{first}' WHEN {second} END AS hit, sg * CASE WHEN adv <= sl THEN least(so, sl) WHEN {price} END AS price FROM h1),
    f AS (SELECT symbol, entry_idx, min(bar_idx) AS exit_idx, arg_min(hit, bar_idx) AS hit, arg_min(price, bar_idx) AS price FROM h2 WHERE hit IS NOT NULL GROUP BY ALL),
    x AS (SELECT c.*, coalesce(f.exit_idx, c.end_idx) AS exit_idx, coalesce(f.price, z.close) AS exit_price, coalesce(f.hit, 'END_OF_DATA') AS tipo_salida FROM c1 c LEFT JOIN f USING (symbol, entry_idx) JOIN b z ON z.symbol = c.symbol AND z.bar_idx = c.end_idx)"""


#: The rule of ``_close_beyond``: the first of eight closes beyond the entry bar's far side.
_OVERRIDE_SQL = """own AS (SELECT x.symbol, x.entry_idx, min(n.bar_idx) AS own_idx FROM x JOIN b e ON e.symbol = x.symbol AND e.bar_idx = x.entry_idx
      JOIN b n ON n.symbol = x.symbol AND n.bar_idx BETWEEN x.entry_idx + 1 AND x.entry_idx + 8 AND CASE WHEN sg > 0 THEN n.close < e.low ELSE n.close > e.high END GROUP BY ALL),
    xo AS (SELECT x.* EXCLUDE (exit_idx, exit_price, exit_time, tipo_salida), coalesce(own_idx, exit_idx) AS exit_idx, coalesce(o.close, exit_price) AS exit_price, CASE WHEN own_idx IS NULL THEN tipo_salida ELSE 'STRATEGY_EXIT' END AS tipo_salida,
      epoch_us(coalesce(o.timestamp, exit_time) - entry_time) / 6e7 AS minutes FROM x LEFT JOIN own USING (symbol, entry_idx) LEFT JOIN b o ON o.symbol = x.symbol AND o.bar_idx = own.own_idx)"""


def _chain_sql(block: int = 0, tag: str = "") -> str:
    """The greedy chain as a recursion: from each trade to the first candidate after its exit."""
    return f"""chain{tag} AS (SELECT symbol, min(entry_idx) AS entry_idx, 1 AS seq FROM x{tag} GROUP BY symbol
    UNION ALL SELECT p.symbol, (SELECT min(n.entry_idx) FROM x{tag} n WHERE n.symbol = p.symbol AND n.entry_idx > p.exit_idx + {block}), p.seq + 1 FROM (SELECT c.symbol, c.seq, x{tag}.exit_idx FROM chain{tag} c JOIN x{tag} USING (symbol, entry_idx)) p WHERE EXISTS (SELECT 1 FROM x{tag} n WHERE n.symbol = p.symbol AND n.entry_idx > p.exit_idx + {block})),
    t{tag} AS (SELECT x{tag}.*, seq, epoch_us(exit_time - entry_time) / 6e7 AS duracion_min FROM chain{tag} JOIN x{tag} USING (symbol, entry_idx))"""


def _account_sql(cfg: T.Config, tag: str = "") -> str:
    entry_fee = f" + qty * entry_price * {cfg.comision_pct}" if cfg.comision_sides >= 2 else ""
    return f"""g0{tag} AS (SELECT *, sg * (exit_price - entry_price) * qty AS pnl, qty * exit_price * {cfg.comision_pct}{entry_fee} AS comision FROM t{tag}),
    g1{tag} AS (SELECT * EXCLUDE (saldo_usado, apalancamiento), pnl - comision AS pnl_neto, {cfg.saldo_inicial} + sum(pnl - comision) OVER (PARTITION BY symbol ORDER BY seq) AS after, saldo_usado AS su FROM g0{tag}),
    g2{tag} AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY symbol ORDER BY seq), {cfg.saldo_inicial}::DOUBLE) AS saldo_antes, min(CASE WHEN after <= {cfg.saldo_minimo} THEN seq END) OVER (PARTITION BY symbol) AS ruin FROM g1{tag}),
    g3{tag} AS (SELECT *, least(su, least({cfg.saldo_usado}, saldo_antes)) AS saldo_usado, greatest(after, 0.0) AS saldo_despues FROM g2{tag} WHERE ruin IS NULL OR seq <= ruin),
    ex{tag} AS (SELECT *, pnl_neto / saldo_usado * 100 AS pnl_pct, volumen / saldo_usado AS apalancamiento FROM g3{tag})"""


def _metric_sql(cfg: T.Config, tag: str = "") -> str:
    s0 = cfg.saldo_inicial
    win, loss = "avg(pnl_neto) FILTER (pnl_neto > 0)", "avg(pnl_neto) FILTER (pnl_neto < 0)"
    pay = f"coalesce({win}, 0) / nullif(abs(coalesce({loss}, 0)), 0)"
    return f"""q0{tag} AS (SELECT symbol, seq, saldo_despues AS equity FROM ex{tag} UNION ALL SELECT DISTINCT symbol, 0, {s0}::DOUBLE FROM ex{tag}),
    q1{tag} AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY seq) AS peak, equity - lag(equity) OVER (PARTITION BY symbol ORDER BY seq) AS delta FROM q0{tag}),
    q{tag} AS (SELECT symbol, max(100.0 * (peak - equity) / peak) AS drawdown, 1 - stddev_pop(delta) / avg(equity) AS estabilidad FROM q1{tag} GROUP BY symbol),
    r0{tag} AS (SELECT symbol, sign(pnl_neto) AS kind, row_number() OVER (PARTITION BY symbol ORDER BY seq) - row_number() OVER (PARTITION BY symbol, sign(pnl_neto) ORDER BY seq) AS run FROM ex{tag}),
    r1{tag} AS (SELECT symbol, kind, run, count(*) AS n FROM r0{tag} GROUP BY ALL),
    r{tag} AS (SELECT symbol, coalesce(max(n) FILTER (kind = 1), 0) AS racha_ganadora, coalesce(max(n) FILTER (kind = -1), 0) AS racha_perdedora FROM r1{tag} GROUP BY symbol),
    p{tag} AS (SELECT symbol, min(timestamp) AS p0, max(timestamp) AS p1 FROM b GROUP BY symbol),
    k0{tag} AS (SELECT symbol, greatest(max(entry_time), max(exit_time)) AS ev1 FROM ex{tag} GROUP BY symbol),
    k{tag} AS (SELECT symbol, p0, least(p1, ev1) AS p1 FROM k0{tag} JOIN p{tag} USING (symbol)),
    v{tag} AS (SELECT e.symbol, count(DISTINCT e.ev::DATE) AS days FROM (SELECT symbol, unnest([entry_time, exit_time]) AS ev FROM ex{tag}) e JOIN k{tag} k ON k.symbol = e.symbol AND e.ev BETWEEN k.p0 AND k.p1 GROUP BY e.symbol),
    a{tag} AS (SELECT symbol, 100.0 * (arg_max(saldo_despues, seq) - {s0}) / {s0} AS roi, 100.0 * avg((pnl_neto > 0)::INT) AS winrate, avg(pnl_neto) AS expectativa, avg(pnl_neto) AS retorno_promedio,
      coalesce(sqrt(count(*)) * avg(pnl_neto) / nullif(stddev_samp(pnl_neto), 0), 0) AS sqn, 100.0 * avg((pnl_neto > 0)::INT) AS porc_ganadoras, 100.0 * avg((pnl_neto < 0)::INT) AS porc_perdedoras, count(*) AS n_trades, count(*) FILTER (type = 'long') AS n_trades_long, count(*) FILTER (type = 'short') AS n_trades_short,
      {pay} AS riesgo_beneficio, {pay} AS payoff_ratio, coalesce(avg(pnl_pct / 100) / nullif(stddev_samp(pnl_pct / 100), 0), 0) AS sharpe, coalesce(avg(pnl_pct / 100) / nullif(stddev_samp(pnl_pct / 100) FILTER (pnl_pct < 0), 0), 0) AS sortino,
      coalesce(sum(pnl_neto) FILTER (pnl_neto > 0), 0) / nullif(abs(coalesce(sum(pnl_neto) FILTER (pnl_neto < 0), 0)), 0) AS profit_factor, arg_max(saldo_despues, seq) AS saldo_actual, min(saldo_despues) AS saldo_min, max(saldo_despues) AS saldo_max, avg(saldo_despues) AS saldo_mean, max(pnl_neto) AS max_ganancia, min(pnl_neto) AS max_perdida, avg(duracion_min) AS duration_mean_min, sum(comision) AS comisiones_total, arg_min(saldo_antes, seq) + sum(pnl) AS saldo_sin_comisiones, sum(pnl_neto) AS pnl_neto,
      epoch_us(max(exit_time) - min(entry_time)) / 86400e6 / 365.25 AS years FROM ex{tag} GROUP BY symbol),
    ms{tag} AS (SELECT a.*, q.drawdown, q.estabilidad, racha_ganadora, racha_perdedora, n_trades / (date_diff('day', k.p0::DATE, k.p1::DATE) + 1) AS trades_por_dia, pnl_neto / v.days AS pnl_neto_por_dia_operado,
      CASE WHEN years <= 0 OR years < 0.001 THEN 0.0 WHEN saldo_actual <= 0 OR power(saldo_actual / {s0}, 1 / years) - 1 > 1e10 THEN NULL ELSE power(saldo_actual / {s0}, 1 / years) - 1 END / nullif(q.drawdown / 100, 0) AS calmar
      FROM a{tag} a JOIN q{tag} q USING (symbol) JOIN r{tag} r USING (symbol) JOIN k{tag} k USING (symbol) JOIN v{tag} v USING (symbol)),
    sc{tag} AS (SELECT *, CASE WHEN trades_por_dia < 0.25 THEN trades_por_dia / 0.25 ELSE 1 + 15 * greatest(sqn, 0) + 20 * least(greatest(coalesce(profit_factor, 1), 1), 4) + 10 * greatest(sortino, 0) + 0.5 * power(100 - drawdown, 1.2) END AS score FROM ms{tag})"""


def _tail(sql: str, table: str, keys: tuple[str, ...], doubles: tuple[str, ...], places: int = 6) -> str:
    return f"{_BASE}, {sql} SELECT {', '.join(keys)}" + "".join(f", {_r(d, places)} AS {d}" for d in doubles) + f" FROM {table}"


def oracle_sql() -> dict[str, str]:
    alma, sg = I.alma_weights(9), {d: I.savgol_weights(11, 3, d) for d in (0, 1, 2)}
    ols30, s = _ols("close", 30), {}
    bars15, bars1 = f"WITH {_TICKS}, {_bars('q', '15 minutes')}", f"WITH {_TICKS}, {_bars('h', '1 hour')}"
    ohlcv = ", ".join(f"{_r(c)} AS {c}" for c in B.OHLCV)
    s["bars_1h"] = f"{_BASE} SELECT symbol, timestamp, bar_idx, {ohlcv} FROM b"
    s["bars_15m"] = f"{bars15} SELECT symbol, timestamp, {ohlcv} FROM q"
    s["bars_daily_lineitem"] = f"WITH ticks AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS timestamp, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS size, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tie FROM lineitem), {_bars('q', '1 day')} SELECT * FROM q"
    s["resample_15m_to_1h"] = f"{bars1} SELECT symbol, timestamp, {ohlcv} FROM h"
    s["date_filter"] = "SELECT event_type AS symbol, ts AS timestamp, value AS price FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"
    steps = "d AS (SELECT symbol, epoch_us(timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp)) // 1000000 AS dsec FROM {0}), l AS (SELECT symbol, list_sort(list(dsec) FILTER (dsec IS NOT NULL)) AS v FROM d GROUP BY symbol)"
    pick = lambda p: f"v[floor((len(v) - 1) * {p} + 0.5)::BIGINT + 1]"
    s["audit"] = f"{bars15}, {steps.format('q')}, g AS (SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT timestamp) AS dup_ts, min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM q GROUP BY symbol), o AS (SELECT symbol, count(*) FILTER (dsec > 1350) AS gaps_gt_1_5x FROM d GROUP BY symbol) SELECT g.*, gaps_gt_1_5x, {pick(0.0)} AS dsec_min, {pick(0.5)} AS dsec_p50, {pick(0.9)} AS dsec_p90, {pick(1.0)} AS dsec_max FROM g JOIN o USING (symbol) JOIN l USING (symbol)"
    s["median_delta_check"] = f"{bars1}, {steps.format('h')} SELECT symbol, {pick(0.5)}::DOUBLE AS median_sec, {pick(0.5)} BETWEEN 2880 AND 4320 AS ok FROM l"
    for name, shift in (("ref", ""), ("safe", " + INTERVAL '1 hour'")):
        s[f"asof_align_{name}"] = f"{bars15}, {_bars('h', '1 hour')}, s AS (SELECT symbol, timestamp{shift} AS timestamp, close > open AS signal_long, close AS close_1h FROM h) SELECT q.symbol, q.timestamp, {_r('q.close')} AS close, coalesce(s.signal_long, false) AS signal_long, {_r('s.close_1h')} AS close_1h FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND q.timestamp >= s.timestamp"
    s["nearest_snap"] = (
        f"{bars1}, e AS (SELECT symbol, timestamp, tie AS event_id FROM ticks), "
        "x AS (SELECT e.*, p.timestamp AS a, n.timestamp AS z FROM e ASOF LEFT JOIN h p ON e.symbol = p.symbol AND e.timestamp >= p.timestamp "
        "ASOF LEFT JOIN h n ON e.symbol = n.symbol AND e.timestamp <= n.timestamp) "
        "SELECT symbol, timestamp, event_id, CASE WHEN a IS NULL OR z - timestamp < timestamp - a THEN coalesce(z, a) ELSE a END AS snap_ts FROM x"
    )
    s["dedup_ts"] = "SELECT event_type AS symbol, date_trunc('minute', ts) AS timestamp, min(event_id) AS event_id FROM events GROUP BY ALL"
    s["null_handling"] = f"{_BASE}, zz AS (SELECT *, {_z('close', 20)} AS z FROM b) SELECT symbol, bar_idx, {_r('CASE WHEN z IS NOT NULL THEN greatest(least(z, 1.0), -1.0) END')} AS clipped, {_r('coalesce(z, 0)')} AS zeroed, z IS NOT NULL AS is_finite, coalesce(z > 0, false) AS filled FROM zz"
    s["sma"] = _select({"sma20": _guard("close", 20, "avg(close)"), "sma3_min1": f"avg(close) OVER {_rows(3)}"})
    s["rolling_std"] = _select({"std20": _guard("close", 20, "stddev_samp(close)")})
    s["rolling_minmax"] = _select({"lo20": _guard("close", 20, "min(close)"), "hi20": _guard("close", 20, "max(close)")})
    s["shift_diff"] = _select({"prev": _lag("close"), "diff": f"close - {_lag('close')}"})
    s["zscore"] = _select({"z": _z("close", 20)})
    gains = f", d AS (SELECT *, close - {_lag('close')} AS dc FROM b), gl AS (SELECT *, CASE WHEN dc > 0 THEN dc ELSE 0.0 END AS gain, CASE WHEN dc < 0 THEN -dc ELSE 0.0 END AS loss FROM d), rs AS (SELECT *, CASE WHEN {_guard('loss', 14, 'avg(loss)')} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {_div(_guard('gain', 14, 'avg(gain)'), _guard('loss', 14, 'avg(loss)'))}) END AS rsi FROM gl)"
    s["rsi"] = _select({"rsi": "rsi"}, gains, "rs")
    s["true_range"] = _select({"tr": "tr", "plus_dm": "pdm", "minus_dm": "mdm"}, f", {_DM}", "m")
    s["ema_span"] = _select({"ema": "v"}, f", {_ewm_cte('em', 'b', 'close', 2 / 21, 1)}", "em")
    s["ema_alpha"] = _select({"ema": "v"}, f", {_ewm_cte('em', 'b', 'close', 0.1, 10)}", "em")
    s["adx"] = _select({"adx": "adx"}, f", {_adx(14, 14)}", "adx")
    s["zscore_ema"] = _select({"z": _z("e", 30)}, f", {_ewm_cte('em', 'b', 'close', 2 / 21, 20)}, ze AS (SELECT symbol, timestamp, v AS e FROM em)", "ze")
    s["alma"] = _select({"alma": _dot("close", alma)})
    for d, weights in sg.items():
        s[f"savgol_{d}"] = _select({"sg": _dot("close", weights)})
    s["linreg_value"] = _select({"linreg": ols30["value"]})
    s["linreg_slope"] = _select({"slope": ols30["slope"]})
    s["rolling_ols"] = _select(ols30)
    s["norm_price"] = _select({"norm": _norm_price(20)})
    s["norm_volume"] = _select({"norm": _norm_volume(20)}, f", {_V3}", "vs")
    s["norm_residual"] = _select({"norm": f"CASE WHEN {_z('g', 20)} IS NOT NULL THEN greatest(least({_z('g', 20)}, 3.0), -3.0) END"}, f", gp AS (SELECT *, close - {_dot('close', alma)} AS g FROM b)", "gp")
    kinds = {"up_strict": ("<", ">"), "up_ge": ("<", ">="), "up_le": ("<=", ">"), "down_strict": (">", "<"), "down_le": (">", "<="), "down_ge": (">=", "<")}
    s["cross_variants"] = _truth({n: _up("close", "50.0", a, z) for n, (a, z) in kinds.items()}, "l1", f", {_lagged('l1', 'b', 'close')}", {})
    s["rising_edge"] = f"{_BASE}, raw AS (SELECT *, coalesce(close > {_guard('close', 5, 'avg(close)')}, false) AS r FROM b) SELECT symbol, bar_idx, r AND NOT coalesce(lag(r) OVER ({_W}), true) AS edge FROM raw"
    s["armed_window"] = f"{_BASE}, zx AS (SELECT *, {_z('close', 20)} AS z, {_z('close', 10)} AS x FROM b), {_armed_sql('zx', 'z', 'x', 1.0, 1.0, 3, 25)} SELECT symbol, bar_idx, signal_long, signal_short FROM s_short"
    s["signals_s0"] = _truth({"signal_long": _up("rsi", "30", "<=", ">"), "signal_short": _up("rsi", "70", ">=", "<")}, "l1", f"{gains}, {_lagged('l1', 'rs', 'rsi')}", {"rsi": "rsi"})
    w11, ols_s2 = {d: I.savgol_weights(11, 3, d) for d in (0, 1, 2)}, _ols("p_smooth", 30)
    k2 = f", k0 AS (SELECT *, first_value(close) OVER ({_W}) AS c0 FROM b), k1 AS (SELECT *, coalesce({_dot('close', w11[0])}, c0) AS p_smooth, coalesce({_dot('close', w11[1])}, 0) AS velocity, coalesce({_dot('close', w11[2])}, 0) AS acceleration FROM k0), k2 AS (SELECT *, {ols_s2['slope']} AS beta, {ols_s2['r2']} AS r2, {ols_s2['ser']} AS ser, {ols_s2['value']} AS yh FROM k1), k3 AS (SELECT *, coalesce((close - yh) / CASE WHEN ser = 0 THEN 1e-9 ELSE ser END, 0) AS z FROM k2), k4 AS (SELECT *, coalesce(beta > 0 AND r2 > 0.3 AND acceleration > 0 AND z < -1.0, false) AS ru, coalesce(beta < 0 AND r2 > 0.3 AND acceleration < 0 AND z > 1.0, false) AS rd FROM k3)"
    edge = lambda c: f"{c} AND NOT coalesce(lag({c}) OVER ({_W}), true)"
    s["signals_s2"] = _truth({"signal_long": edge("ru"), "signal_short": edge("rd")}, "k4", k2, {c: c for c in ("p_smooth", "velocity", "acceleration", "beta", "r2")})
    s["signals_s3"] = f"{_BASE}, {_s3(20)} SELECT symbol, bar_idx, {_r('ma_hl')} AS ma_hl, signal_long, signal_short FROM sig"
    ols100 = _ols("close", 100)
    s["signals_s7"] = _truth({"signal_long": f"{_up('z', '-1.0', '<', '>')} AND close < linreg", "signal_short": f"{_up('z', '1.0', '>', '<')} AND close > linreg"}, "l1", f", {_z_ema(20, 30)}, lr AS (SELECT *, coalesce({ols100['value']}, first_value(close) OVER ({_W})) AS linreg FROM zs), {_lagged('l1', 'lr', 'z')}", {"z_score": "z", "linreg": "linreg"})
    s["signals_s9"] = _truth({"signal_long": f"{_up('z', '-1.0', '<', '>')} AND linreg_slope > 0", "signal_short": f"{_up('z', '1.0', '>', '<')} AND linreg_slope < 0"}, "l1", f", {_z_ema(20, 50)}, lr AS (SELECT *, coalesce({ols100['slope']}, 0) AS linreg_slope FROM zs), {_lagged('l1', 'lr', 'z')}", {"z_score": "z", "linreg_slope": "linreg_slope"})
    s["signals_s10"] = _truth({"signal_long": "sig > 0 AND p_sig <= 0 AND adx > 15 AND adx > p_adx", "signal_short": "sig < 0 AND (p_sig >= 0 OR (p_sig IS NULL AND bar_idx > 0)) AND adx > 15"}, "l1", f", {_adx(14, 14)}, {_V3}, fu AS (SELECT symbol, timestamp, bar_idx, ({_norm_price(50)}) * {_norm_volume(50)} AS fusion FROM vs), fs AS (SELECT f.symbol, f.timestamp, f.bar_idx, {_dot('fusion', I.alma_weights(15)).replace('PARTITION BY symbol ORDER BY timestamp', 'PARTITION BY f.symbol ORDER BY f.timestamp')} AS sig, a.adx FROM fu f JOIN adx a ON a.symbol = f.symbol AND a.bar_idx = f.bar_idx), {_lagged('l1', 'fs', 'sig', 'adx')}", {"adx": "adx", "fusion_signal": "sig"})
    n11 = f"CASE WHEN {_z('g', 20)} IS NOT NULL THEN greatest(least({_z('g', 20)}, 3.0), -3.0) END"
    s["signals_s11"] = f"{_BASE}, n0 AS (SELECT *, {_z('close', 20)} AS z, {_dot('close', I.alma_weights(20))} AS alma FROM b), n1 AS (SELECT *, close - alma AS g FROM n0), n2 AS (SELECT *, {n11} AS x FROM n1), {_armed_sql('n2', 'z', 'x', 1.5, 2.0, 4, 25)} SELECT symbol, bar_idx, {_r('z')} AS z_score, {_r('alma')} AS alma, {_r('x')} AS norm_price, signal_long, signal_short FROM s_short"
    s["position_size"] = _tail(_exit_sql(replace(CFG, qty=100.0)), "c2", ("symbol", "entry_idx", "type"), ("entry_price", "saldo_usado", "qty", "volumen", "apalancamiento"))
    exit_keys, exit_vals = ("symbol", "type", "entry_idx", "exit_idx", "tipo_salida"), ("entry_price", "exit_price", "sl_distance")
    s["exit_fixed"] = _tail(_exit_sql(CFG), "x", exit_keys, exit_vals)
    s["exit_trailing"] = _tail(_exit_sql(TRAIL), "x", exit_keys, exit_vals)
    s["exit_wide"] = _tail(_exit_sql(WIDE), "x", exit_keys, exit_vals).replace(_BASE, _minute_sql())
    s["exit_override"] = _tail(f"{_exit_sql(CFG)}, {_OVERRIDE_SQL}", "xo", exit_keys, (*exit_vals, "minutes"))
    for name, atr_cfg in (("fixed", ATR_FIXED), ("trailing", ATR_TRAIL)):
        s[f"exit_atr_{name}"] = _tail(_atr_exit_sql(atr_cfg), "x", exit_keys, tuple(v for v in exit_vals if v != "sl_distance"))
    s["atr_wilder"] = _select({"atr": "atr"}, f", {_atr_sql(14)}", "atr")
    s["trailing_trace"] = f"""{_BASE}, {_exit_sql(TRAIL)} SELECT h.symbol, h.bar_idx, upper(h.type) AS side, h.entry_idx, best0 >= h.act AS trailing_active_before, best >= h.act AS trailing_active_after,
      {", ".join(f"{_r(v)} AS {k}" for k, v in {"open": "o", "high": "h", "low": "l", "close": "cl", "entry_price": "h.entry_price", "qty": "h.qty", "sl_price": "h.sg * h.sl", "tp_price": "h.sg * h.tp", "trail_act_price": "h.sg * h.act", "trail_dist_price": "h.dist", "max_fav_before": "h.sg * best0", "max_fav_after": "h.sg * best", "trailing_price": "CASE WHEN best >= h.act THEN h.sg * (best - h.dist) END", "pnl_eur_close": "h.sg * (cl - h.entry_price) * h.qty", "pnl_pct_stake_close": "h.sg * (cl - h.entry_price) * h.qty / h.saldo_usado * 100", "hit_exit_price": "h.price"}.items())}, h.hit AS hit_reason
      FROM h2 h JOIN x ON x.symbol = h.symbol AND x.entry_idx = h.entry_idx AND h.bar_idx <= x.exit_idx"""
    for name, block in (("trades_nonoverlap", 0), ("trades_cooldown", 5)):
        s[name] = f"{_BASE}, {_exit_sql(CFG)}, {_chain_sql(block)} SELECT symbol, seq::BIGINT AS seq, entry_idx, exit_idx FROM t"
    exec_keys, exec_vals = ("symbol", "seq::BIGINT AS seq", "entry_idx", "exit_idx"), tuple(c for c in EXEC_COLS if c not in ("symbol", "seq", "entry_idx", "exit_idx"))
    for name, cfg in (("account_sim", CFG), ("account_ruin", RUIN), ("account_long", RICH)):
        s[name] = _tail(f"{_exit_sql(cfg)}, {_chain_sql()}, {_account_sql(cfg)}", "ex", exec_keys, exec_vals, MONEY)
    ran = f"{_exit_sql(CFG)}, {_chain_sql()}, {_account_sql(CFG)}, {_metric_sql(CFG)}"
    s["equity_drawdown"] = f"{_BASE}, {ran} SELECT symbol, seq::BIGINT AS seq, {_r('equity', MONEY)} AS equity, {_r('peak', MONEY)} AS peak, {_r('peak - equity', MONEY)} AS drawdown, {_r('100.0 * (peak - equity) / peak', MONEY)} AS drawdown_pct FROM q1"
    s["streaks"] = f"{_BASE}, {ran} SELECT symbol, racha_ganadora, racha_perdedora FROM r"
    s["longest_trade"] = f"{_BASE}, {ran} SELECT symbol, entry_idx, exit_idx, {_r('duracion_min')} AS duracion_min FROM ex QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY duracion_min DESC, entry_idx) = 1"
    whole = {"n_trades", "n_trades_long", "n_trades_short", "racha_ganadora", "racha_perdedora"}
    s["metrics_summary"] = _tail(ran, "ms", ("symbol", *sorted(whole)), tuple(c for c in SUMMARY_COLS if c not in whole), MONEY)
    none = {c: CFG.saldo_inicial if c in ("saldo_actual", "saldo_min", "saldo_max", "saldo_mean", "saldo_sin_comisiones") else None if c in ("riesgo_beneficio", "payoff_ratio", "profit_factor") else 0.0 for c in SUMMARY_COLS}
    filled = ", ".join(f"CASE WHEN ms.symbol IS NULL THEN {'NULL' if v is None else v}::DOUBLE ELSE {c}::DOUBLE END AS {c}" for c, v in none.items())
    empty = f"{ran}, me AS (SELECT u.symbol, {filled} FROM (SELECT DISTINCT symbol FROM b) u LEFT JOIN ms ON ms.symbol = u.symbol AND u.symbol < 'm')"
    s["metrics_empty"] = _tail(empty, "me", ("symbol", *(f"{c}::BIGINT AS {c}" for c in sorted(whole))), tuple(c for c in SUMMARY_COLS if c not in whole), MONEY)
    s["score"] = _tail(ran, "sc", ("symbol",), ("score",), MONEY)
    rich = f"{_exit_sql(RICH)}, {_chain_sql()}, {_account_sql(RICH)}, {_metric_sql(RICH)}"
    s["metrics_long"] = _tail(rich, "ms", ("symbol", *sorted(whole)), tuple(c for c in SUMMARY_COLS if c not in whole), MONEY)
    s["score_long"] = _tail(rich, "sc", ("symbol",), ("score",), MONEY)
    tags = [(f"_{n}", n, k, sl, tp) for n, k, sl, tp in TRIALS]
    sweep_sql = ", ".join(f"{_exit_sql(CFG, k, t, sl, tp)}, {_chain_sql(0, t)}, {_account_sql(CFG, t)}, {_metric_sql(CFG, t)}" for t, _, k, sl, tp in tags)
    union = " UNION ALL ".join(f"SELECT y.symbol, {n}::BIGINT AS trial, n_trades, saldo_actual, coalesce(score, 0) AS score FROM (SELECT DISTINCT symbol FROM b) y LEFT JOIN sc{t} USING (symbol)" for t, n, *_ in tags)
    every = f"{_BASE}, {sweep_sql}, u AS ({union})"
    s["sweep_topk"] = f"{every} SELECT symbol, trial, n_trades, {_r('score')} AS score, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, trial) AS rank FROM u QUALIFY rank <= 2"
    runs = [(f"_{t}{n}", t, n, replace(CFG, exit_type=t), *own) for t in ("pnl_fixed", "pnl_trailing") for n, own in enumerate(GIVEN)]
    told = ", ".join(f"{_exit_sql(c, k, t, sl, tp)}, {_chain_sql(0, t)}, {_account_sql(c, t)}, {_metric_sql(c, t)}" for t, _, _, c, k, sl, tp in runs)
    trials = " UNION ALL ".join(f"SELECT y.asset, '{kind}' AS exit_type, {n}::BIGINT AS trial, coalesce(score, 0) AS score FROM (SELECT unnest({list(STUDIED)}) AS asset) y LEFT JOIN sc{t} ON symbol = asset" for t, kind, n, *_ in runs)
    named = "asset || '_crossover_hl_ma_' || exit_type AS study, asset, 'crossover_hl_ma' AS strategy, exit_type, trial, CASE WHEN score > 0 THEN 'complete' ELSE 'empty' END AS state"
    s["trials_table"] = f"{_BASE}, {told}, u AS ({trials}) SELECT {named}, {_r('score')} AS score FROM u"
    s["best_so_far"] = f"{every} SELECT symbol, trial, {_r('score')} AS score, {_r('max(score) OVER (PARTITION BY symbol ORDER BY trial)')} AS best_score FROM u"
    s["summary_table"] = f"{every} SELECT 'crossover_hl_ma' AS \"ESTRATEGIA\", symbol AS \"SYMBOL\", trial AS \"TRIAL\", n_trades AS \"N_TRADES\", round(saldo_actual, 4) AS \"SALDO_ACTUAL\", round(score, 4) AS \"SCORE\" FROM u"
    s["chart_candles"] = f"{_BASE} SELECT symbol, epoch(timestamp)::BIGINT AS t, round_even(open * 100, 0)::BIGINT AS o, round_even(high * 100, 0)::BIGINT AS h, round_even(low * 100, 0)::BIGINT AS l, round_even(close * 100, 0)::BIGINT AS c FROM b"
    s["chart_markers"] = f"{_BASE}, {ran}, ev AS (SELECT symbol, entry_time AS at, 'entry_' || type AS mark, seq, entry_price AS price FROM ex UNION ALL SELECT symbol, exit_time, 'exit_' || tipo_salida, seq, exit_price FROM ex) SELECT ev.symbol, epoch(ev.at)::BIGINT AS t, mark, seq::BIGINT AS seq, {_r('price')} AS price FROM ev JOIN b ON b.symbol = ev.symbol AND b.timestamp = ev.at WHERE b.bar_idx >= 20"
    return s
