"""Summary tables, per-trial trade files and chart data as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, unix_seconds
from tidemark.operators.bars import dedup, nearest


def summary_table(metrics: DataFrame, strategy: str, digits: int = 2) -> DataFrame:
    """Upper-case columns, numbers rounded, best final balance first, nothing empty through and through.

    Which columns are empty is one aggregate of one row.
    """
    counts = metrics.agg(*[F.count(c).alias(c) for c in metrics.columns]).collect()[0].asDict()
    shown = [c for c, t in metrics.dtypes if counts[c] and not c.startswith("_")]
    kinds = dict(metrics.dtypes)
    cols = [(F.round(c, digits) if kinds[c] == "double" else F.col(c)).alias(c.upper()) for c in shown]
    order = "SALDO_ACTUAL" if "saldo_actual" in shown else "SCORE"
    return metrics.select(F.lit(strategy).alias("ESTRATEGIA"), *cols).orderBy(F.col(order).desc_nulls_last())


def append(df: DataFrame, path: str, first_trial: bool = False, fmt: str = "parquet") -> None:
    """Add a batch's rows to a table; the first trial starts it anew."""
    out = df.write.mode("overwrite" if first_trial else "append")
    out.parquet(path) if fmt == "parquet" else out.csv(path, header=True)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, with the columns of either."""
    return old.unionByName(new, allowMissingColumns=True)


def best_trades(executed: DataFrame, metrics: DataFrame, k: int) -> DataFrame:
    """Trades of each symbol's k best trials only."""
    w = W.partitionBy("symbol").orderBy(F.col("score").desc(), "trial")
    best = metrics.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("symbol", "trial")
    return executed.join(best, ["symbol", "trial"], "left_semi")


def write_best_trades(executed: DataFrame, metrics: DataFrame, k: int, path: str) -> None:
    best_trades(executed, metrics, k).repartition("symbol", "trial").write.mode("overwrite").partitionBy("symbol", "trial").parquet(path)


def longest_trade(executed: DataFrame, *by: str) -> DataFrame:
    cols = F.struct(*[c for c in executed.columns if c not in by])
    return executed.groupBy(*by).agg(F.max_by(cols, F.struct("duracion_min", -F.col("entry_idx"))).alias("t")).select(*by, "t.*")


# --- chart data ------------------------------------------------------------


def quantised(c: Column, places: int = 2) -> Column:
    """Prices as integers, ties to even; null for what is no number."""
    return F.when(finite(c), F.bround(c * 10**places, 0).cast("long"))


def candles(bars: DataFrame, places: int = 2) -> DataFrame:
    """symbol, t (Unix seconds), o, h, l, c: unique in time, complete, as integers."""
    whole = dedup(bars, F.col("bar_idx")).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("open", "high", "low", "close")))
    return whole.select("symbol", unix_seconds(F.col("timestamp")).alias("t"), *[quantised(F.col(c), places).alias(c[0]) for c in ("open", "high", "low", "close")])


def aligned(bars: DataFrame, indicators: DataFrame, names: list[str]) -> DataFrame:
    """Indicators at exactly the candles' times; null where there is none or no number."""
    clean = indicators.select("symbol", "timestamp", *[F.when(finite(F.col(n)), F.col(n)).alias(n) for n in names])
    return bars.select("symbol", "timestamp").join(clean, ["symbol", "timestamp"], "left")


def plot_range(bars: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Bars of the wanted dates; all of them if there are none."""
    from tidemark.sources.bars import between

    part = between(bars, first, last)
    return bars if part.isEmpty() else part


def before_ruin(bars: DataFrame, curve: DataFrame, floor: float = 5.0) -> DataFrame:
    """Bars up to the share of the equity curve at which it first falls to the floor."""
    cut = curve.groupBy("symbol").agg(F.min(F.when(F.col("equity") <= floor, F.col("seq"))).alias("ruin"), F.count("*").alias("points"))
    n = bars.groupBy("symbol").agg(F.count("*").alias("bars"))
    limit = n.join(cut, "symbol", "left").select("symbol", F.when(F.col("ruin").isNotNull(), F.floor(F.col("bars") * (F.col("ruin") + 1) / F.col("points"))).otherwise(F.col("bars")).alias("limit"))
    return bars.join(limit, "symbol").where(F.col("bar_idx") < F.col("limit")).drop("limit")


def panels(bars: DataFrame, names: list[str], own: dict[str, str] | None = None) -> dict[str, str]:
    """ "overlay" for indicators on the prices' scale, "sub" for others; one aggregate of one row. A strategy's own choice wins.

    An overlay lies within 15 % of the price span on either side, and spans from a tenth to one and a half of it. An indicator
    below zero beside prices above 100, or of a span under 20 beside prices above 50, is none.
    """
    value = lambda n: F.when(finite(F.col(n)), F.col(n))
    got = bars.agg(F.min("low").alias("low"), F.max("high").alias("high"), *[f(value(n)).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))]).collect()[0].asDict()
    low, high = got["low"], got["high"]

    def place(n: str) -> str:
        least, most = got[f"{n}_min"], got[f"{n}_max"]
        if least is None or low is None or not low < high:
            return "sub"
        span, prices = most - least, high - low
        if (least < 0 and low > 100) or (span < 20 and low > 50):
            return "sub"
        return "overlay" if least >= low - 0.15 * prices and most <= high + 0.15 * prices and 0.1 * prices <= span <= 1.5 * prices else "sub"

    chosen = {k: v for k, v in (own or {}).items() if v in ("overlay", "sub")}
    return {n: chosen.get(n) or place(n) for n in names}


#: Forms of the names of parameters that give a panel's lines, best first; {} is the indicator (fixed values).
LEVEL_NAMES = {
    "period": ("{}_period", "period_{}", "{}_length", "length_{}", "{}_len", "{}_window", "window_{}", "period", "length"),
    "hi": ("{}_overbought", "overbought_{}", "{}_ob", "{}_upper", "upper_{}", "{}_hi", "hi_{}", "{}_threshold_hi"),
    "lo": ("{}_oversold", "oversold_{}", "{}_os", "{}_lower", "lower_{}", "{}_lo", "lo_{}", "{}_threshold_lo"),
    "entry_long": ("entry_long_{}", "{}_entry_long", "entry_long", "long_entry_{}", "{}_long_entry", "entry_level_long"),
    "entry_short": ("entry_short_{}", "{}_entry_short", "entry_short", "short_entry_{}", "{}_short_entry", "entry_level_short"),
    "exit_long": ("exit_long_{}", "{}_exit_long", "exit_long", "long_exit_{}", "{}_long_exit", "exit_level_long"),
    "exit_short": ("exit_short_{}", "{}_exit_short", "exit_short", "short_exit_{}", "{}_short_exit", "exit_level_short"),
}


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def levels(params: dict, indicator: str) -> dict[str, float]:
    """An indicator's period and lines from the names of parameters; the middle lies halfway between hi and lo."""
    out: dict[str, float] = {}
    for line, forms in LEVEL_NAMES.items():
        found = (_number(params.get(form.format(indicator.lower()))) for form in forms)
        if (value := next((v for v in found if v is not None), None)) is not None:
            out[line] = int(value) if line == "period" else value
    if "hi" in out and "lo" in out:
        out["mid"] = (out["hi"] + out["lo"]) / 2
    return out


def warmup_bars(params: dict, least: int = 1) -> int:
    """Declared warm-up if it is a positive number, else the largest parameter named like a length; ``least`` at least."""
    whole = lambda v: int(_number(v) or 0)
    lengths = [whole(v) for k, v in params.items() if k.lower().endswith(("_period", "_length", "_len", "_window"))]
    return max(least, whole(params.get("__warmup_bars")) if whole(params.get("__warmup_bars")) > 0 else max(lengths, default=0))


def markers(executed: DataFrame, bars: DataFrame, warmup: int = 0) -> DataFrame:
    """Entry and exit marks at the nearest candle, after the warm-up."""
    events = executed.select("symbol", F.explode(F.array(F.struct(F.col("entry_time").alias("timestamp"), F.concat(F.lit("entry_"), "type").alias("mark"), F.col("seq"), F.col("entry_price").alias("price")), F.struct(F.col("exit_time").alias("timestamp"), F.concat(F.lit("exit_"), "tipo_salida").alias("mark"), F.col("seq"), F.col("exit_price").alias("price")))).alias("e")).select("symbol", "e.*")
    keyed = events.withColumn("key", F.struct("mark", "seq", "price"))
    snapped = nearest(keyed, bars, "key")
    at = bars.select("symbol", F.col("timestamp").alias("snap_ts"), "bar_idx")
    return snapped.join(at, ["symbol", "snap_ts"]).where(F.col("bar_idx") >= warmup).select("symbol", unix_seconds(F.col("snap_ts")).alias("t"), "key.mark", "key.seq", "key.price")


def header(metrics: DataFrame) -> DataFrame:
    """What a chart's head shows; the win rate is a percentage as it stands."""
    return metrics.select(*[c for c in ("symbol", "trial", "n_trades", "winrate", "roi", "drawdown", "saldo_actual", "score") if c in metrics.columns])
