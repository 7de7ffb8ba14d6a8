"""Exits by multiples of the average true range: fixed levels, or a stop that only tightens.

Both find their bar over the tree of block extremes. The tightening stop follows the close
less a multiple of the bar's own range, so the tree carries that in place of the high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import atr_wilder
from tidemark.operators.first_hit import extremes, first_hits
from tidemark.operators.trades import _closed
from tidemark.session import cut


@dataclass(frozen=True)
class AtrConfig:
    """Multiples of the range (fixed values where none are given)."""

    exit_type: str = "atr_fixed"
    atr_period: int = 14
    sl_atr: float = 1.0
    tp_atr: float = 1.0
    trailing_atr_mult: float = 2.0
    emergency_sl_atr_mult: float = 4.0


def atr_settings(params: dict, base: AtrConfig = AtrConfig()) -> AtrConfig:
    """From ``__exit_*``, ``exit_*`` or ``base``: a period of at least 1, multiples without their sign."""
    pick = lambda name: params.get(f"__exit_{name}", params.get(f"exit_{name}", getattr(base, name)))
    multiples = {name: abs(float(pick(name))) for name in ("sl_atr", "tp_atr", "trailing_atr_mult", "emergency_sl_atr_mult")}
    return AtrConfig(str(pick("type") if "exit_type" in params or "__exit_type" in params else base.exit_type).strip().lower(), max(1, int(pick("atr_period"))), **multiples)


def _usable(atr: Column) -> Column:
    """The range, or where it is unset or not positive the bar's own height, a thousandth of its close at least."""
    return F.when(atr > 0, atr).otherwise(F.greatest(F.col("high") - F.col("low"), F.col("close") * 0.001))


def _with_range(entries: DataFrame, ranged: DataFrame, series: tuple[str, ...]) -> DataFrame:
    at = ranged.select(*series, F.col("bar_idx").alias("entry_idx"), F.col("_range").alias("_atr"))
    sign = F.when(F.col("type") == "long", 1.0).otherwise(-1.0)
    return entries.join(at, [*series, "entry_idx"]).withColumn("sign", sign)


def atr_exits(entries: DataFrame, bars: DataFrame, cfg: AtrConfig = AtrConfig(), series: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add exit_idx, exit_time, exit_price and tipo_salida to the candidates ``entries``.

    "atr_fixed": stop and target from the range at the entry, a multiple of 0 meaning none. "atr_trailing": an emergency stop
    from the range at the entry, before a stop that starts one range behind it and follows the closes. Gaps fill at the open.
    """
    ranged = cut(atr_wilder(bars, cfg.atr_period, series).withColumn("_range", _usable(F.col("atr"))))
    state = _with_range(entries, ranged, series)
    entry, inf, width = F.col("sign") * F.col("entry_price"), float("inf"), F.col("_atr")
    if cfg.exit_type == "atr_trailing":
        move = F.col("_range") * cfg.trailing_atr_mult
        tree, top = extremes(ranged, series, F.col("close") - move, F.col("close") + move)
        stop = entry - width * cfg.emergency_sl_atr_mult
        levels = {"s_sl": stop, "s_tp": F.lit(inf), "s_act": F.lit(-inf), "s_dist": F.lit(0.0), "trailing": F.lit(True), "best": stop - width}
    else:
        tree, top = extremes(ranged, series)
        stop = entry - width * cfg.sl_atr if cfg.sl_atr > 0 else F.lit(-inf)
        goal = entry + width * cfg.tp_atr if cfg.tp_atr > 0 else F.lit(inf)
        levels = {"s_sl": stop, "s_tp": goal, "s_act": F.lit(inf), "s_dist": F.lit(0.0), "trailing": F.lit(False), "best": entry}
    done = _closed(first_hits(state.withColumns(levels), tree, top, series), bars, entries.columns, series)
    if cfg.exit_type != "atr_trailing":
        return done
    return done.withColumn("tipo_salida", F.when(F.col("tipo_salida") == "SL", "SL_EMERGENCY").otherwise(F.col("tipo_salida")))


def pnl_pct(entry: Column, now: Column, side: Column) -> Column:
    """Percent of the entry price won by ``side`` ("long", else short); 0 where the entry is not positive."""
    sign = F.when(F.lower(side) == "long", 1.0).otherwise(-1.0)
    return F.when(entry <= 0, 0.0).otherwise(sign * (now - entry) / entry * 100.0)


def pct_exit(entry: Column, side: Column, open_: Column, high: Column, low: Column, sl_pct: Column, tp_pct: Column) -> Column:
    """Struct (reason, price) of one bar against levels in percent of the entry price; null where neither is touched.

    The stop comes first and fills at the open behind a gap; the target fills at its level.
    """
    long = F.lower(side) == "long"
    stop = entry * (1.0 - F.when(long, sl_pct).otherwise(-sl_pct) / 100.0)
    goal = entry * (1.0 + F.when(long, tp_pct).otherwise(-tp_pct) / 100.0)
    stopped, won = F.when(long, low <= stop).otherwise(high >= stop), F.when(long, high >= goal).otherwise(low <= goal)
    filled = F.when(long, F.least(open_, stop)).otherwise(F.greatest(open_, stop))
    hit = lambda reason, price: F.struct(F.lit(reason).alias("reason"), price.alias("price"))
    return F.when(entry > 0, F.when(stopped, hit("SL", filled)).when(won, hit("TP", goal)))
