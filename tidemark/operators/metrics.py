"""Summary metrics of executed trades, and the score that ranks parameter sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, safe_div
from tidemark.operators.trades import Config, equity
from tidemark.session import cut

#: Other names of metrics that readers may ask for, without regard to case (fixed values).
METRIC_ALIASES = {
    "winrate": ("win_rate", "wr", "win_pct", "win_percent",),
    "sharpe": ("sharpe_ratio", "sharperatio", "sr",),
    "sortino": ("sortino_ratio", "sortinoratio",),
    "profit_factor": ("profitfactor", "pf", "profit_f",),
    "drawdown": ("max_drawdown", "maxdrawdown", "dd", "max_dd", "mdd",),
    "roi": ("return_pct", "return_percent", "retorno", "pnl_percent",),
    "saldo_actual": ("saldo_final", "final_balance", "balance", "saldo",),
    "comisiones_total": ("comisiones", "commissions", "total_comm", "fees",),
    "n_trades": ("total_trades", "num_trades", "trades", "trade_count",),
    "n_trades_long": ("count_longs", "num_longs", "longs", "long_count", "n_longs",),
    "n_trades_short": ("count_shorts", "num_shorts", "shorts", "short_count", "n_shorts",),
    "pnl_neto": ("pnl", "net_pnl", "profit", "net_profit",),
    "pnl_neto_por_dia_operado": ("pnl_por_dia_operado", "pnl_dia_operado", "net_pnl_per_trading_day", "net_pnl_per_operated_day",),
}
_NAMED = {other: name for name, others in METRIC_ALIASES.items() for other in others}


def annualised(ratio: Column, trades_per_day: Column) -> Column:
    """A ratio of single trades, such as ``sharpe``, scaled to a year by the trades of a day."""
    return ratio * F.sqrt(F.greatest(trades_per_day * 365.25, F.lit(0.0)))


def metric(df: DataFrame, name: str) -> Column:
    """A metric's column by any of its names, without regard to case."""
    key = name.strip().lower()
    have = {c.lower(): c for c in df.columns}
    return F.col(have[key] if key in have else have[_NAMED.get(key, key)])


def streaks(executed: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """racha_ganadora, racha_perdedora: the longest runs of gains and losses; a zero breaks both."""
    kind = F.signum("pnl_neto")
    w = W.partitionBy(*by)
    runs = executed.select(*by, "seq", kind.alias("kind")).withColumn("run", F.row_number().over(w.orderBy("seq")) - F.row_number().over(W.partitionBy(*by, "kind").orderBy("seq")))
    sizes = runs.groupBy(*by, "kind", "run").agg(F.count("*").alias("n"))
    longest = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return sizes.groupBy(*by).agg(longest(1).alias("racha_ganadora"), longest(-1).alias("racha_perdedora"))


def _day(c: Column) -> Column:
    return F.to_date(c)


def summary(executed: DataFrame, cfg: Config, period: DataFrame | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row of metrics for each key. ``period`` has period_start and period_end of each key, if wanted.

    Undefined ratios are null. The equity curve includes the initial balance.
    """
    executed = cut(executed)  # read by five branches, whose steps would all lie in one task with those before them
    n, net = F.count("*"), F.col("pnl_neto")
    win, loss = net > 0, net < 0
    avg_if = lambda c: F.coalesce(F.avg(F.when(c, net)), F.lit(0.0))
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, net)), F.lit(0.0))
    r = F.col("pnl_pct") / 100.0
    last = F.max_by("saldo_despues", "seq")
    sd, down = F.stddev_samp(r), F.stddev_samp(F.when(r < 0, r))
    good = F.when(finite(net), net)
    pay = safe_div(avg_if(win), F.abs(avg_if(loss)))
    base = executed.groupBy(*by).agg(
        (100.0 * (last - cfg.saldo_inicial) / cfg.saldo_inicial if cfg.saldo_inicial else F.lit(0.0)).alias("roi"),
        F.avg(F.when(win, 100.0).otherwise(0.0)).alias("winrate"),
        F.avg(net).alias("expectativa"),
        F.avg(net).alias("retorno_promedio"),
        F.coalesce(safe_div(F.sqrt(F.count(good)) * F.avg(good), F.stddev_samp(good), 0.0), F.lit(0.0)).alias("sqn"),
        F.avg(F.when(win, 100.0).otherwise(0.0)).alias("porc_ganadoras"),
        F.avg(F.when(loss, 100.0).otherwise(0.0)).alias("porc_perdedoras"),
        n.alias("n_trades"),
        F.count_if(F.col("type") == "long").alias("n_trades_long"),
        F.count_if(F.col("type") == "short").alias("n_trades_short"),
        pay.alias("riesgo_beneficio"),
        pay.alias("payoff_ratio"),
        F.coalesce(safe_div(F.avg(r), sd, 0.0), F.lit(0.0)).alias("sharpe"),
        F.coalesce(safe_div(F.avg(r), down, 0.0), F.lit(0.0)).alias("sortino"),
        safe_div(sum_if(win), F.abs(sum_if(loss))).alias("profit_factor"),
        last.alias("saldo_actual"),
        F.min("saldo_despues").alias("saldo_min"),
        F.max("saldo_despues").alias("saldo_max"),
        F.avg("saldo_despues").alias("saldo_mean"),
        F.max(net).alias("max_ganancia"),
        F.min(net).alias("max_perdida"),
        F.avg("duracion_min").alias("duration_mean_min"),
        F.sum("comision").alias("comisiones_total"),
        (F.min_by("saldo_antes", "seq") + F.sum("pnl")).alias("saldo_sin_comisiones"),
        F.sum(net).alias("pnl_neto"),
        F.min("entry_time").alias("_first"),
        F.max("exit_time").alias("_last"),
        F.greatest(F.max("entry_time"), F.max("exit_time")).alias("_event_last"),
        F.least(F.min("entry_time"), F.min("exit_time")).alias("_event_first"),
    )
    curve = equity(executed, cfg, by).groupBy(*by).agg(F.max("drawdown_pct").alias("drawdown"), F.max("drawdown").alias("drawdown_abs"), F.coalesce(1 - safe_div(F.stddev_pop("delta"), F.avg("equity")), F.lit(0.0)).alias("estabilidad"))
    out = base.join(curve, list(by)).join(streaks(executed, by), list(by))
    if period is not None:
        out = out.join(period.select(*by, "period_start", "period_end"), list(by), "left")
    else:
        out = out.withColumns({"period_start": F.lit(None).cast("timestamp_ntz"), "period_end": F.lit(None).cast("timestamp_ntz")})
    both = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    out = out.withColumns({"_from": F.when(both, F.col("period_start")).otherwise(F.col("_event_first")), "_to": F.when(both, F.least("period_end", "_event_last")).otherwise(F.col("_event_last"))})
    days = F.datediff(_day(F.col("_to")), _day(F.col("_from"))) + 1
    events = executed.select(*by, F.explode(F.array("entry_time", "exit_time")).alias("event")).join(out.select(*by, "_from", "_to"), list(by)).where(F.col("event").between(F.col("_from"), F.col("_to")))
    worked = events.groupBy(*by).agg(F.countDistinct(_day(F.col("event"))).alias("_days"))
    out = out.join(worked, list(by), "left")
    years = F.greatest((F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 86_400e6, F.lit(0.0)) / 365.25
    grown = F.col("saldo_actual") / cfg.saldo_inicial if cfg.saldo_inicial > 0 else F.lit(0.0)
    power = F.pow(grown, safe_div(F.lit(1.0), years)) - 1
    cagr = F.when(years < 0.001, 0.0).when(grown <= 0, None).when(grown > 1e6, None).when(power > 1e10, None).otherwise(power)
    ratio = safe_div(cagr, F.col("drawdown") / 100.0)
    out = out.withColumns({
        "trades_por_dia": F.when(days > 0, F.col("n_trades") / days).otherwise(0.0),
        "pnl_neto_por_dia_operado": F.coalesce(safe_div(F.col("pnl_neto"), F.col("_days").cast("double"), 0.0), F.lit(0.0)),
        "calmar": F.when(finite(ratio), ratio),
    })
    return out.drop("_first", "_last", "_event_first", "_event_last", "_from", "_to", "_days", "period_start", "period_end")


#: What a run without trades reports beside zeros (fixed values): ratios that are undefined, and balances.
UNDEFINED = ("riesgo_beneficio", "payoff_ratio", "profit_factor")
BALANCES = ("saldo_actual", "saldo_min", "saldo_max", "saldo_mean", "saldo_sin_comisiones")


def with_empty(metrics: DataFrame, every: DataFrame, cfg: Config, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``metrics`` with a row for each key of ``every``: one without trades has zeros and the initial balance."""
    made = metrics.withColumn("_made", F.lit(True))
    both = every.select(*by).distinct().join(made, list(by), "left")
    kinds = dict(metrics.dtypes)

    def filled(c: str) -> Column:
        start = F.lit(None) if c in UNDEFINED else F.lit(cfg.saldo_inicial if c in BALANCES else 0)
        return F.when(F.col("_made").isNull(), start.cast(kinds[c])).otherwise(F.col(c)).alias(c)

    return both.select(*by, *[filled(c) for c in metrics.columns if c not in by])


def score(tpd: Column, sqn: Column, profit_factor: Column, sortino: Column, drawdown: Column) -> Column:
    """Below a quarter trade a day activity alone, up to 1; from there on quality, gains over losses and shallow drawdowns."""
    known = lambda c, other: F.when(finite(c), c).otherwise(other)
    rate = known(tpd, 0.0)
    dd = F.greatest(F.least(known(drawdown, 100.0), F.lit(100.0)), F.lit(0.0))
    full = 1 + 15 * F.greatest(known(sqn, 0.0), F.lit(0.0)) + 20 * F.least(F.greatest(known(profit_factor, 1.0), F.lit(1.0)), F.lit(4.0)) + 10 * F.greatest(known(sortino, 0.0), F.lit(0.0)) + 0.5 * F.pow(100 - dd, F.lit(1.2))
    return F.when(rate < 0.25, F.greatest(rate, F.lit(0.0)) / 0.25).otherwise(full)


def scored(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("score", score(F.col("trades_por_dia"), F.col("sqn"), F.col("profit_factor"), F.col("sortino"), F.col("drawdown")))
