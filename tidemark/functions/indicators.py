"""Rolling indicators as Column builders over a window of one series in time order.

``w`` is a window spec partitioned by the series' keys and ordered by time. A warm-up is
null. All builders share one partitioning and order, so Catalyst plans one exchange
and one sort for any number of them; none uses a Python function. ``adx``, ``atr_wilder`` and the
exponential means (``scan.ewm``) take bars instead and split a series over chunks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, is_true, safe_div
from tidemark.functions.scan import CHUNK, affine_scan, core, ewm, haloed


def _last(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def _full(x: Column, w: WindowSpec, k: int, value: Column, least: int | None = None) -> Column:
    return F.when(F.count(x).over(_last(w, k)) >= (k if least is None else least), value)


def prev(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(w)


def diff(x: Column, w: WindowSpec) -> Column:
    return x - prev(x, w)


def sma(x: Column, w: WindowSpec, k: int, least: int | None = None) -> Column:
    return _full(x, w, k, F.avg(x).over(_last(w, k)), least)


def rolling_std(x: Column, w: WindowSpec, k: int) -> Column:
    return _full(x, w, k, F.stddev_samp(x).over(_last(w, k)))


def rolling_min(x: Column, w: WindowSpec, k: int) -> Column:
    return _full(x, w, k, F.min(x).over(_last(w, k)))


def rolling_max(x: Column, w: WindowSpec, k: int) -> Column:
    return _full(x, w, k, F.max(x).over(_last(w, k)))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = prev(close, w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def directional_moves(high: Column, low: Column, w: WindowSpec) -> tuple[Column, Column]:
    up, down = high - prev(high, w), prev(low, w) - low
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def adx(df: DataFrame, length: int, smooth: int, by: tuple[str, ...] = ("symbol",), chunk: int = CHUNK) -> DataFrame:
    """Add ``adx`` to bars of dense ``bar_idx``; a series may lie in many chunks."""
    columns = [c for c in df.columns if c != "adx"]
    spread, w = haloed(df, 1, by, most=chunk)
    plus, minus = directional_moves(F.col("high"), F.col("low"), w)
    moved = core(spread.withColumns({"_tr": true_range(F.col("high"), F.col("low"), F.col("close"), w), "_up": plus, "_dn": minus}))
    means = {"_atr": F.col("_tr"), "_pdm": F.col("_up"), "_mdm": F.col("_dn")}
    smoothed = ewm(moved, means, alpha=1.0 / length, least=length, by=by, most=chunk)
    up, down = (safe_div(F.col(c), F.col("_atr")) * 100 for c in ("_pdm", "_mdm"))
    directed = smoothed.withColumn("_dx", safe_div(F.abs(up - down), up + down) * 100)
    return ewm(directed, {"adx": F.col("_dx")}, alpha=1.0 / smooth, least=smooth, by=by, most=chunk).select(*columns, "adx")


def atr_wilder(df: DataFrame, period: int, by: tuple[str, ...] = ("symbol",), chunk: int = CHUNK) -> DataFrame:
    """Add ``atr``: the mean of the first ``period`` true ranges, then each bar moves it by one part in ``period``; null before."""
    columns = [c for c in df.columns if c != "atr"]
    spread, w = haloed(df, 1, by, most=chunk)
    ranged = core(spread.withColumn("_tr", true_range(F.col("high"), F.col("low"), F.col("close"), w)))
    seeds = ranged.where(F.col("bar_idx") < period).groupBy(*by).agg(F.avg("_tr").alias("_seed"))  # a row for each series
    at = F.col("bar_idx")
    add = F.when(at < period - 1, 0.0).when(at == period - 1, F.col("_seed")).otherwise(F.col("_tr") / period)
    seeded = ranged.join(seeds, list(by)).withColumn("_add", add)
    if period <= 1:
        return seeded.select(*columns, F.col("_tr").alias("atr"))
    moved = affine_scan(seeded, {"atr": (F.col("_add"), (period - 1) / period)}, by, most=chunk)
    return moved.select(*columns, F.when(at >= period - 1, F.col("atr")).alias("atr"))


def weighted(x: Column, w: WindowSpec, weights: np.ndarray) -> Column:
    """Dot product of the last values, oldest first, with fixed weights; null with any null among them."""
    k = len(weights)
    values = F.collect_list(x).over(_last(w, k))
    fixed = F.array(*[F.lit(float(v)) for v in weights])
    return F.when(F.size(values) == k, F.aggregate(F.zip_with(values, fixed, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def alma_weights(k: int, offset: float = 0.85, sigma: float = 6.0) -> np.ndarray:
    if k <= 1:
        return np.ones(max(k, 1))
    i = np.arange(k)
    v = np.exp(-((i - offset * (k - 1)) ** 2) / (2 * (k / sigma) ** 2))
    return v / v.sum()


def alma(x: Column, w: WindowSpec, k: int) -> Column:
    return weighted(x, w, alma_weights(k))


def savgol_weights(k: int, poly: int, deriv: int) -> np.ndarray:
    """Causal least squares: the polynomial over the last k points, or a derivative of it, at the newest."""
    powers = np.vander(np.arange(-(k - 1), 1, dtype=float), poly + 1, increasing=True)
    return np.linalg.pinv(powers)[deriv] * math.factorial(deriv)


def savgol(x: Column, w: WindowSpec, k: int, poly: int, deriv: int = 0) -> Column:
    return weighted(x, w, savgol_weights(k, poly, deriv))


def zscore(x: Column, w: WindowSpec, k: int) -> Column:
    return safe_div(x - sma(x, w, k), rolling_std(x, w, k))


def ols(y: Column, idx: Column, w: WindowSpec, k: int) -> dict[str, Column]:
    """Slope, value at the newest point, r2 and standard error of a line through the last k points."""
    frame, x = _last(w, k), idx.cast("double")
    slope, sse = F.regr_slope(y, x).over(frame), None
    syy, r2 = F.regr_syy(y, x).over(frame), F.regr_r2(y, x).over(frame)
    sse = F.greatest(syy * (1 - r2), F.lit(0.0))
    value = F.regr_intercept(y, x).over(frame) + slope * x
    guard = lambda v: _full(y, w, k, v)
    return {"slope": guard(slope), "value": guard(value), "r2": guard(F.when(syy == 0, 0.0).otherwise(r2)), "ser": guard(F.when(syy == 0, 0.0).otherwise(F.sqrt(sse / (k - 2))) if k > 2 else F.lit(0.0))}


def rsi(close: Column, w: WindowSpec, k: int) -> Column:
    d = diff(close, w)
    gain, loss = (sma(F.when(c, v).otherwise(0.0), w, k) for c, v in ((d > 0, d), (d < 0, -d)))
    return F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + safe_div(gain, loss)))


def norm_price(close: Column, w: WindowSpec, k: int) -> Column:
    """Place in the rolling range, from -2 to 2; a flat range counts as one wide."""
    low, high = rolling_min(close, w, k), rolling_max(close, w, k)
    return -2.0 + (close - low) * 4.0 / F.when(high - low == 0, 1.0).otherwise(high - low)


def norm_volume(smooth: Column, w: WindowSpec, k: int) -> Column:
    """Place of a smoothed volume in its rolling range, from 0.5 to 1.5; 1 in the warm-up."""
    low, high = rolling_min(smooth, w, k), rolling_max(smooth, w, k)
    return F.coalesce(0.5 + (smooth - low) / F.when(high - low == 0, 1.0).otherwise(high - low), F.lit(1.0))


def norm_residual(residual: Column, w: WindowSpec, k: int, limit: float = 3.0) -> Column:
    return clip(zscore(residual, w, k), -limit, limit)


_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def cross(x: Column, level: Column | float, w: WindowSpec, before: str, now: str, level_before: Column | None = None) -> Column:
    """The last value was ``before`` the level and this one is ``now``; for example "<" and ">=" for a way up."""
    level = level if isinstance(level, Column) else F.lit(level)
    return is_true(_COMPARE[before](prev(x, w), level if level_before is None else level_before) & _COMPARE[now](x, level))


def rising_edge(raw: Column, w: WindowSpec) -> Column:
    """True where ``raw`` is and the bar before wasn't; never on the first bar."""
    return is_true(raw) & ~F.coalesce(F.lag(is_true(raw)).over(w), F.lit(True))
