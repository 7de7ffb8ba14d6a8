"""Strategies: search spaces and signals as Column expressions.

A strategy turns indexed bars into the same rows with its indicators and the booleans
``signal_long`` and ``signal_short``; it adds no shuffle to the one that orders a series.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions.scalar import is_true, or_zero, safe_div
from tidemark.operators.bars import series


@dataclass(frozen=True)
class Int:
    low: int
    high: int
    step: int = 1


@dataclass(frozen=True)
class Float:
    low: float
    high: float
    step: float | None = None


@dataclass(frozen=True)
class Choice:
    values: tuple


class Strategy(Protocol):
    combinacion_id: int
    name: str

    def space(self, chosen: dict[str, Any]) -> dict[str, Any]: ...

    def signals(self, bars: DataFrame, params: dict[str, Any], by: tuple[str, ...] = ("symbol",)) -> DataFrame: ...


_REGISTRY: dict[int, Strategy] = {}


def register(cls):
    """Class decorator: an id may be taken once; what lacks the contract is refused."""
    made = cls()
    for part in ("combinacion_id", "name", "space", "signals"):
        if not hasattr(made, part):
            raise TypeError(f"{cls.__name__} has no {part}")
    if made.combinacion_id in _REGISTRY:
        raise ValueError(f"strategy id {made.combinacion_id} is taken by {_REGISTRY[made.combinacion_id].name}")
    _REGISTRY[made.combinacion_id] = made
    return cls


def discover() -> dict[int, Strategy]:
    """Strategies by id; the template (id 0) is not one of them."""
    return {k: v for k, v in sorted(_REGISTRY.items()) if k}


def find(key: int | str) -> Strategy:
    """By id, or by name without regard to case."""
    for k, v in _REGISTRY.items():
        if k == key or str(key).strip().lower() == v.name.lower():
            return v
    raise KeyError(key)


def _entry(df: DataFrame, up, down, **shown) -> DataFrame:
    return df.withColumns({**shown, "signal_long": is_true(up), "signal_short": is_true(down)})


@register
class RsiTemplate:
    combinacion_id, name = 0, "rsi_template"

    def space(self, chosen):
        return {}

    def signals(self, bars, params, by=("symbol",)):
        w = series(*by)
        df = bars.withColumn("rsi", I.rsi(F.col("close"), w, int(params.get("rsi_period", 14))))
        low, high, rsi = float(params.get("rsi_oversold", 30.0)), float(params.get("rsi_overbought", 70.0)), F.col("rsi")
        return _entry(df, I.cross(rsi, low, w, "<=", ">"), I.cross(rsi, high, w, ">=", "<"))


@register
class KinematicDivergence:
    """A trend by regression, an acceleration with it, a price away against it."""

    combinacion_id, name = 2, "kinematic_divergence"

    def space(self, chosen):
        # Fixed values.
        return {
            "sg_window": Int(7, 35, 2),
            "sg_poly": Int(2, min(4, chosen.get("sg_window", 35) - 2)),
            "ols_window": Int(30, 100, 5),
            "r2_min": Float(0.60, 0.90, 0.05),
            "z_thr": Float(1.2, 2.5, 0.1),
        }

    def signals(self, bars, params, by=("symbol",)):
        w, close = series(*by), F.col("close")
        window, poly, k = int(params.get("sg_window", 21)), int(params.get("sg_poly", 3)), int(params.get("ols_window", 50))
        r2_min, thr = float(params.get("r2_min", 0.7)), float(params.get("z_thr", 1.5))
        window += 1 - window % 2
        poly = min(poly, window - 2) if poly >= window else poly
        first = F.first("close").over(w.rowsBetween(W.unboundedPreceding, 0))
        df = bars.withColumns({"p_smooth": F.coalesce(I.savgol(close, w, window, poly, 0), first), "velocity": F.coalesce(I.savgol(close, w, window, poly, 1), F.lit(0.0)), "acceleration": F.coalesce(I.savgol(close, w, window, poly, 2), F.lit(0.0))})
        line = I.ols(F.col("p_smooth"), F.col("bar_idx"), w, k)
        df = df.withColumns({"beta": line["slope"], "r2": line["r2"], "ser": line["ser"], "y_hat": line["value"]})
        df = df.withColumn("z_score", or_zero(safe_div(close - F.col("y_hat"), F.when(F.col("ser") == 0, 1e-9).otherwise(F.col("ser")))))
        trend = F.col("r2") > r2_min
        up = (F.col("beta") > 0) & trend & (F.col("acceleration") > 0) & (F.col("z_score") < -thr)
        down = (F.col("beta") < 0) & trend & (F.col("acceleration") < 0) & (F.col("z_score") > thr)
        return _entry(df.drop("ser", "y_hat"), I.rising_edge(up, w), I.rising_edge(down, w))


@register
class CrossoverMidpoint:
    """The close crosses a moving average of the bar's midpoint."""

    combinacion_id, name = 3, "crossover_hl_ma"

    def space(self, chosen):
        return {"hl_period": Int(20, 150, 5), "ma_type": Choice(("sma", "ema", "alma"))}  # fixed values

    def signals(self, bars, params, by=("symbol",)):
        w, k, kind = series(*by), max(5, min(150, int(params.get("hl_period", 50)))), params.get("ma_type", "sma")
        mid = F.col("hl_mid")
        df = bars.withColumn("hl_mid", (F.col("high") + F.col("low")) / 2.0)
        if kind == "ema":
            df = I.ewm(df, {"ma_hl": mid}, span=k, by=by)
        else:
            df = df.withColumn("ma_hl", I.alma(mid, w, k) if kind == "alma" else I.sma(mid, w, k))
        close, line = F.col("close"), F.col("ma_hl")
        before, line_before = I.prev(close, w), I.prev(line, w)
        below = before < line_before
        if kind == "alma" and params.get("nan_warmup", True):
            below = below | (line_before.isNull() & before.isNotNull())  # an unset average is above any price
        return _entry(df, below & (close > line), (before > line_before) & (close < line))


def _z_of_ema(df: DataFrame, w, params: dict, lookback: int, by: tuple[str, ...]) -> DataFrame:
    k, z = int(params.get("ema_len", 20)), int(params.get("z_lookback", lookback))
    df = I.ewm(df, {"ema": F.col("close")}, span=k, least=k, by=by)
    ema = F.col("ema")
    full = I.rolling_std(ema, w, z)
    return df.withColumn("z_score", F.when(full == 0, 0.0).otherwise(safe_div(ema - I.sma(ema, w, z), full)))


#: Ranges of both strategies on the z-score of an average (fixed values).
PULLBACK_SPACE = {"ema_len": Int(10, 50, 5), "z_lookback": Int(20, 100, 10), "linreg_len": Int(50, 200, 10), "z_threshold": Float(1.5, 3.0, 0.1)}


@register
class ZScoreLinReg:
    """The z-score of an average comes back from an extreme while the price is beyond a regression line."""

    combinacion_id, name = 7, "zscore_linreg"

    def space(self, chosen):
        return PULLBACK_SPACE

    def signals(self, bars, params, by=("symbol",)):
        w, thr, k = series(*by), float(params.get("z_threshold", 2.0)), int(params.get("linreg_len", 100))
        first = F.first("close").over(w.rowsBetween(W.unboundedPreceding, 0))
        df = _z_of_ema(bars, w, params, 30, by).withColumn("linreg", F.coalesce(I.ols(F.col("close"), F.col("bar_idx"), w, k)["value"], first))
        z, line = F.col("z_score"), F.col("linreg")
        return _entry(df.drop("ema"), I.cross(z, -thr, w, "<", ">") & (F.col("close") < line), I.cross(z, thr, w, ">", "<") & (F.col("close") > line))


@register
class ZScorePullback:
    """The z-score of an average comes back from an extreme in the direction of the slope."""

    combinacion_id, name = 9, "zscore_pullback"

    def space(self, chosen):
        return PULLBACK_SPACE

    def signals(self, bars, params, by=("symbol",)):
        w, thr, k = series(*by), float(params.get("z_threshold", 2.0)), int(params.get("linreg_len", 100))
        df = _z_of_ema(bars, w, params, 50, by).withColumn("linreg_slope", F.coalesce(I.ols(F.col("close"), F.col("bar_idx"), w, k)["slope"], F.lit(0.0)))
        z, slope = F.col("z_score"), F.col("linreg_slope")
        return _entry(df.drop("ema"), I.cross(z, -thr, w, "<", ">") & (slope > 0), I.cross(z, thr, w, ">", "<") & (slope < 0))


@register
class MomentumFusion:
    """A smoothed product of place in the range and volume crosses zero in a strong trend."""

    combinacion_id, name = 10, "momentum_fusion"

    def space(self, chosen):
        # Fixed values.
        return {
            "len_price": Int(40, 120, 2),
            "len_vol": Int(10, 50, 2),
            "alma_len": Int(8, 25),
            "adx_len": Int(7, 21),
            "adx_smooth": Int(7, 14),
            "adx_thr": Int(16, 30, 2),
        }

    def signals(self, bars, params, by=("symbol",)):
        w, close = series(*by), F.col("close")
        at = lambda name, other: int(params.get(name, other))
        df = I.adx(bars, at("adx_len", 14), at("adx_smooth", 14), by).withColumn("v_smooth", I.sma(F.col("volume"), w, 3, least=1))
        df = df.withColumn("fusion", I.norm_price(close, w, at("len_price", 50)) * I.norm_volume(F.col("v_smooth"), w, at("len_vol", 50)))
        df = df.withColumn("fusion_signal", I.alma(F.col("fusion"), w, at("alma_len", 15)))
        sig, before, strong = F.col("fusion_signal"), I.prev(F.col("fusion_signal"), w), F.col("adx") > float(params.get("adx_thr", 20.0))
        above = before >= 0
        if params.get("nan_warmup", True):
            above = above | (before.isNull() & (F.col("bar_idx") > 0))  # an unset value counts as the largest
        return _entry(df.drop("v_smooth", "fusion"), (sig > 0) & (before <= 0) & strong & (F.col("adx") > I.prev(F.col("adx"), w)), (sig < 0) & above & strong)


def armed(df: DataFrame, z: str, x: str, w, by: tuple[str, ...], z_thr: float, x_thr: float, wait: int, warmup: int) -> DataFrame:
    """Add signal_long and signal_short of the armed-window rule.

    z crossing back from an extreme arms a few bars; the first of x's crossings back
    inside them, with z still on its side, fires and disarms. A later arming starts anew.
    """
    zc, xc = F.col(z), F.col(x)
    zp, xp = F.lag(zc).over(w), F.lag(xc).over(w)
    live = (F.col("bar_idx") >= warmup) & zc.isNotNull() & zp.isNotNull() & xc.isNotNull() & xp.isNotNull()
    for side, sign in (("long", 1.0), ("short", -1.0)):
        arm = live & (sign * zp < -z_thr) & (sign * zc >= -z_thr)
        fire = live & (sign * xp < -x_thr) & (sign * xc >= -x_thr) & (sign * zc < 0)
        df = df.withColumns({"_arm": F.last(F.when(arm, F.col("bar_idx")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_fire": fire})
        df = df.withColumn("_fire", is_true(F.col("_fire") & (F.col("bar_idx") - F.col("_arm") <= wait)))
        nth = F.sum(F.col("_fire").cast("int")).over(W.partitionBy(*by, "_arm").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0))
        df = df.withColumn(f"signal_{side}", F.col("_fire") & (nth == 1))
    return df.drop("_arm", "_fire")


@register
class ZScoreNormalised:
    """Armed by the price's z-score, fired by its normalised distance from a smooth average."""

    combinacion_id, name = 11, "zscore_normalised"

    def space(self, chosen):
        # Fixed values; ``signals`` clamps both thresholds and the wait to narrower bounds.
        return {
            "z_window": Int(10, 100, 5),
            "z_thr": Float(1.3, 3.0, 0.1),
            "alma_window": Int(5, 100, 5),
            "norm_window": Int(50, 100, 5),
            "norm_thr": Float(2.0, 3.0, 0.1),
            "wait_bars": Int(1, 10),
        }

    def signals(self, bars, params, by=("symbol",)):
        w, close = series(*by), F.col("close")
        z, a, n = (int(params.get(p, 50)) for p in ("z_window", "alma_window", "norm_window"))
        clamp = lambda v, low, high: max(low, min(high, v))
        z_thr, n_thr, wait = clamp(float(params.get("z_thr", 2.0)), 1.5, 2.5), clamp(float(params.get("norm_thr", 2.5)), 2.0, 3.0), clamp(int(params.get("wait_bars", 2)), 1, 4)
        df = bars.withColumns({"z_score": I.zscore(close, w, z), "alma": I.alma(close, w, a) if a > 1 else F.lit(None).cast("double")})
        df = df.withColumn("_gap", close - F.col("alma"))
        df = df.withColumn("norm_price", I.norm_residual(F.col("_gap"), w, n)).drop("_gap")
        return armed(df, "z_score", "norm_price", w, by, z_thr, n_thr, wait, max(z, a, n) + 5)
