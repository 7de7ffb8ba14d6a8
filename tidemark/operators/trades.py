"""Entries, sizing, intrabar exits, non-overlapping selection and the account.

Size and exit of a candidate depend on no other trade, so both are computed for all
candidates at once; only the choice of non-overlapping ones and the running balance
are ordered, on the far smaller table of trades.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import minutes_between, safe_div
from tidemark.operators.first_hit import extremes, first_hits
from tidemark.operators.selection import SHORT, chosen


@dataclass(frozen=True)
class Config:
    """Account, sizing and exits. Percentages are of the margin of a trade."""

    saldo_inicial: float = 300.0
    saldo_minimo: float = 15.0
    saldo_usado: float = 75.0
    apalancamiento_max: float = 60.0
    qty: float = 1.0
    comision_pct: float = 0.00043
    comision_sides: int = 1
    exit_type: str = "pnl_fixed"
    sl_pct: float = 20.0
    tp_pct: float = 20.0
    trail_act_pct: float = 10.0
    trail_dist_pct: float = 5.0
    block_bars: int = 0


def exit_settings(params: dict, base: Config = Config()) -> dict:
    """Exit settings from ``__exit_*``, ``exit_*`` or the defaults: positive, zeros replaced, distance at most half the activation."""
    pick = lambda name, other: params.get(f"__exit_{name}", params.get(f"exit_{name}", other))
    whole = lambda v, zero: abs(float(v)) or zero
    act = whole(pick("trail_act_pct", base.trail_act_pct), 0.5)
    return {
        "exit_type": str(pick("type", base.exit_type)).strip().lower(),
        "sl_pct": whole(pick("sl_pct", base.sl_pct), 1.0),
        "tp_pct": whole(pick("tp_pct", base.tp_pct), 1.0),
        "trail_act_pct": act,
        "trail_dist_pct": min(whole(pick("trail_dist_pct", base.trail_dist_pct), 0.25), act / 2),
    }


def with_settings(df: DataFrame, cfg: Config) -> DataFrame:
    """Add cfg's exit settings, quantity and margin as columns where ``df`` has none of its own (a sweep has)."""
    s = exit_settings({}, cfg)
    values = {k: s[k] for k in ("sl_pct", "tp_pct", "trail_act_pct", "trail_dist_pct")} | {"trailing": s["exit_type"] == "pnl_trailing", "target_qty": cfg.qty}
    return df.withColumns({k: F.lit(v) for k, v in values.items() if k not in df.columns})


def candidates(signals: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Entries at the close of signal bars but the last of a series; a bar with both signals is long."""
    last = F.max("bar_idx").over(W.partitionBy(*by))
    extra = [c for c in ("target_qty", "sl_pct", "tp_pct", "trail_act_pct", "trail_dist_pct", "trailing") if c in signals.columns]
    hit = signals.withColumn("end_idx", last).where((F.col("signal_long") | F.col("signal_short")) & (F.col("bar_idx") < F.col("end_idx")))
    return hit.select(*by, F.when(F.col("signal_long"), "long").otherwise("short").alias("type"), F.col("bar_idx").alias("entry_idx"), F.col("timestamp").alias("entry_time"), F.col("close").alias("entry_price"), "end_idx", *extra)


def position_size(entries: DataFrame, cfg: Config) -> DataFrame:
    """Add saldo_usado, qty, volumen and apalancamiento (not below 1); qty shrinks to the leverage limit."""
    margin = min(cfg.saldo_usado, cfg.saldo_inicial) if cfg.saldo_inicial > 0 else cfg.saldo_usado
    limit = cfg.apalancamiento_max if cfg.apalancamiento_max > 0 else 60.0
    p, wanted = F.col("entry_price"), F.when(F.col("target_qty") > 0, F.col("target_qty")).otherwise(1e-4)
    need = wanted * p / margin if margin > 0 else F.lit(1.0)
    held = F.when(need > limit, F.when(p > 0, F.lit(margin * limit) / p).otherwise(1e-4)).otherwise(wanted)
    qty = F.when(held <= 0, 1e-4).otherwise(held)
    sized = with_settings(entries, cfg).withColumns({"saldo_usado": F.lit(float(margin)), "apalancamiento": F.greatest(F.lit(1.0), F.least(need, F.lit(limit))), "qty": qty})
    return sized.withColumn("volumen", F.col("qty") * p)


def _levels(sized: DataFrame) -> DataFrame:
    """Prices times the side's sign, so that one set of rules serves both: a short is a long of negated prices."""
    sign = F.when(F.col("type") == "long", 1.0).otherwise(-1.0)
    away = lambda c: F.col("saldo_usado") * (F.col(c) / 100.0) / F.col("qty")
    entry = sign * F.col("entry_price")
    df = sized.withColumns({"sign": sign, "sl_distance": away("sl_pct"), "s_sl": entry - away("sl_pct"), "s_tp": entry + away("tp_pct"), "s_act": entry + away("trail_act_pct"), "s_dist": away("trail_dist_pct")})
    return df.withColumn("sl_distance", F.when(F.col("sl_distance") > 0, F.col("sl_distance")).otherwise(F.col("entry_price") * 0.01))


def exits(sized: DataFrame, bars: DataFrame, by: tuple[str, ...] = ("symbol",), series: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add exit_idx, exit_time, exit_price, tipo_salida and sl_distance to every candidate.

    Stop loss before trailing stop before take profit; gaps fill at the open. Those without a hit close at the
    series' end. ``bars`` is read twice: hand over bars that are written or cheap to derive.
    """
    tree, top = extremes(bars, series)
    state = _levels(sized).withColumn("best", F.col("sign") * F.col("entry_price"))
    return _closed(first_hits(state, tree, top, series), bars, sized.columns + ["sl_distance"], series)


def _closed(hits: DataFrame, bars: DataFrame, own: list[str], series: tuple[str, ...]) -> DataFrame:
    """``own`` columns with the exit of each hit; the last bar's close where there is none."""
    ends = bars.groupBy(*series).agg(F.max_by(F.struct("timestamp", "close"), "bar_idx").alias("final"))
    hit = F.col("hit").isNotNull()
    pick = lambda inside, other: F.when(hit, F.col(inside)).otherwise(F.col(other))
    return hits.join(ends, list(series), "left").select(
        *own,
        pick("hit.idx", "end_idx").alias("exit_idx"),
        pick("hit.timestamp", "final.timestamp").alias("exit_time"),
        pick("hit.price", "final.close").alias("exit_price"),
        F.coalesce("hit.reason", F.lit("END_OF_DATA")).alias("tipo_salida"),
    )


def trailing_trace(exited: DataFrame, bars: DataFrame, by: tuple[str, ...] = ("symbol",), series: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each bar from entry to exit, with levels and state before and after it."""
    span = 1024
    state = _levels(exited.drop("sl_distance")).withColumns({"at": F.col("entry_idx"), "best": F.col("sign") * F.col("entry_price")})
    pieces = state.withColumn("block", F.explode(F.sequence(F.floor((F.col("entry_idx") + 1) / span).cast("long"), F.floor(F.col("exit_idx") / span).cast("long"))))
    ohlc = bars.select(*series, "bar_idx", "timestamp", "open", "high", "low", "close", F.floor(F.col("bar_idx") / span).cast("long").alias("block"))
    met = pieces.join(ohlc, [*series, "block"]).where((F.col("bar_idx") > F.col("entry_idx")) & (F.col("bar_idx") <= F.col("exit_idx")))
    fav = F.when(F.col("sign") > 0, F.col("high")).otherwise(-F.col("low"))
    w = W.partitionBy(*by, "entry_idx").orderBy("bar_idx")
    met = met.withColumn("after", F.greatest("best", F.max(fav).over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("before", F.coalesce(F.lag("after").over(w), F.col("best")))
    signed = lambda c: F.col("sign") * F.col(c)
    pnl = F.col("sign") * (F.col("close") - F.col("entry_price")) * F.col("qty")
    last = F.col("bar_idx") == F.col("exit_idx")
    return met.select(*by, "bar_idx", "timestamp", "open", "high", "low", "close", F.upper("type").alias("side"), "entry_idx", "entry_price", "qty", F.col("saldo_usado").alias("stake"), "sl_pct", "tp_pct", "trail_act_pct", "trail_dist_pct",
                      signed("s_sl").alias("sl_price"), signed("s_tp").alias("tp_price"), signed("s_act").alias("trail_act_price"), F.col("s_dist").alias("trail_dist_price"), signed("before").alias("max_fav_before"), signed("after").alias("max_fav_after"),
                      (F.col("before") >= F.col("s_act")).alias("trailing_active_before"), (F.col("after") >= F.col("s_act")).alias("trailing_active_after"), F.when(F.col("after") >= F.col("s_act"), F.col("sign") * (F.col("after") - F.col("s_dist"))).alias("trailing_price"),
                      pnl.alias("pnl_eur_close"), (safe_div(pnl, F.col("saldo_usado"), 0.0) * 100).alias("pnl_pct_stake_close"), F.when(last & (F.col("tipo_salida") != "END_OF_DATA"), F.col("tipo_salida")).alias("hit_reason"), F.when(last & (F.col("tipo_salida") != "END_OF_DATA"), F.col("exit_price")).alias("hit_exit_price"))


Decide = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
_OWN = "own_idx long, own_price double, own_reason string"


def override_exits(exited: DataFrame, bars: DataFrame, decide: Decide, by: tuple[str, ...] = ("symbol",), series: tuple[str, ...] = ("symbol",), before: int = 0, ahead: int = 0, span: int = 1024) -> DataFrame:
    """Let a strategy's own decision replace engine exits.

    ``decide`` gets the candidates of one slice of ``span`` bars and their bars, from ``before`` bars before the slice to
    ``ahead`` behind it, both in order. It returns exit_idx, exit_price and tipo_salida for each candidate: a null exit_idx keeps the
    engine's exit, a null price is the close of the new bar, a null reason is STRATEGY_EXIT. Indices beyond the series mean its last bar;
    one at or before the entry is an error, as it could never end. Time and sl_distance follow the new bar.
    """
    keys = [*by, "entry_idx"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in exited.select(*keys).schema) + ", " + _OWN

    def rows(candidates: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty:
            return pd.DataFrame(columns=[*keys, "own_idx", "own_price", "own_reason"])
        candidates = candidates.sort_values(keys).reset_index(drop=True)
        near = near.drop(columns="_near").rename(columns={f"_{c}": c for c in series}).sort_values("bar_idx").reset_index(drop=True)
        own = decide(candidates.drop(columns="_slice"), near).reset_index(drop=True)
        took = own["exit_idx"].notna()
        if (own.loc[took, "exit_idx"] <= candidates.loc[took, "entry_idx"]).any():
            raise ValueError("an exit must come after its entry")
        reason = own["tipo_salida"].where(own["tipo_salida"].notna() & (own["tipo_salida"] != ""), "STRATEGY_EXIT").astype(str)
        out = candidates.loc[took, keys].assign(own_idx=own.loc[took, "exit_idx"].astype("int64"), own_price=own.loc[took, "exit_price"].astype("float64"), own_reason=reason[took])
        return out

    slice_ = lambda c: F.floor(c / span).cast("long")
    reach = F.sequence(F.greatest(F.lit(0), slice_(F.col("bar_idx") - ahead)), slice_(F.col("bar_idx") + before))
    sliced = bars.select(*[F.col(c).alias(f"_{c}" if c in series else c) for c in bars.columns], F.explode(reach).alias("_near"))
    grouped = exited.withColumn("_slice", slice_(F.col("entry_idx"))).groupBy(*series, "_slice")
    own = grouped.cogroup(sliced.groupBy(*[f"_{c}" for c in series], "_near")).applyInPandas(rows, schema)
    last = bars.groupBy(*series).agg(F.max("bar_idx").alias("last"))
    own = own.join(last, list(series)).withColumn("own_idx", F.least("own_idx", "last")).drop("last")
    at = bars.select(*series, F.col("bar_idx").alias("own_idx"), F.col("timestamp").alias("own_time"), F.col("close").alias("own_close"))
    both = exited.join(own.join(at, [*series, "own_idx"]), keys, "left")
    took = F.col("own_idx").isNotNull()
    pct = F.col("sl_pct") / 100.0
    distance = F.when((F.col("qty") > 0) & (F.col("saldo_usado") > 0), F.col("saldo_usado") * pct / F.col("qty")).otherwise(F.col("entry_price") * pct)
    new = {"exit_idx": F.col("own_idx"), "exit_time": F.col("own_time"), "exit_price": F.coalesce("own_price", "own_close"), "tipo_salida": F.col("own_reason"), "sl_distance": distance}
    return both.select(*[F.when(took, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in exited.columns])


def nonoverlapping(exited: DataFrame, by: tuple[str, ...] = ("symbol",), block_bars: int = 0, short: int = SHORT) -> DataFrame:
    """Of each series' candidates the greedy sequence: none opens before, on, or within block_bars after the last exit."""
    slim = exited.select(*by, "entry_idx", (F.col("exit_idx") + max(block_bars, 0)).alias("free"))
    # A trade opens on one side of a bar, so keys and entry name it.
    taken = exited.join(chosen(slim, by, short), [*by, "entry_idx"])
    return taken.withColumn("duracion_min", minutes_between(F.col("entry_time"), F.col("exit_time")))


def account(trades: DataFrame, cfg: Config, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add pnl, comision, pnl_neto, pnl_pct, saldo_antes and saldo_despues; stop after the trade that ruins the account.

    The balance is a running sum; as it stops at or above zero, ``saldo_minimo`` must not be negative.
    """
    if cfg.saldo_minimo < 0:
        raise ValueError("saldo_minimo must not be negative")
    w = W.partitionBy(*by).orderBy("seq")
    sign = F.when(F.col("type") == "long", 1.0).otherwise(-1.0)
    gross = sign * (F.col("exit_price") - F.col("entry_price")) * F.col("qty")
    fee = F.col("qty") * F.col("exit_price") * cfg.comision_pct + (F.col("qty") * F.col("entry_price") * cfg.comision_pct if cfg.comision_sides >= 2 else F.lit(0.0))
    run = trades.withColumns({"pnl": gross, "comision": fee}).withColumn("pnl_neto", F.col("pnl") - F.col("comision"))
    run = run.withColumn("after", F.lit(cfg.saldo_inicial) + F.sum("pnl_neto").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("saldo_antes", F.coalesce(F.lag("after").over(w), F.lit(cfg.saldo_inicial)))
    ruined = F.min(F.when(F.col("after") <= cfg.saldo_minimo, F.col("seq"))).over(W.partitionBy(*by))
    run = run.withColumn("ruin", ruined).where((F.col("ruin").isNull() | (F.col("seq") <= F.col("ruin"))) & F.lit(cfg.saldo_inicial > cfg.saldo_minimo))
    free = F.least(F.lit(cfg.saldo_usado), F.col("saldo_antes"))
    stake = F.when(F.col("saldo_usado") <= 0, free).when(free > 0, F.least("saldo_usado", free)).otherwise(F.col("saldo_usado"))
    run = run.withColumn("saldo_usado", stake)
    return run.withColumns({"saldo_despues": F.greatest(F.col("after"), F.lit(0.0)), "pnl_pct": F.when(F.col("saldo_usado") > 0, F.col("pnl_neto") / F.col("saldo_usado") * 100).otherwise(0.0), "volumen": F.col("qty") * F.col("entry_price"), "apalancamiento": F.when(F.col("saldo_usado") > 0, F.col("qty") * F.col("entry_price") / F.col("saldo_usado")).otherwise(1.0)}).drop("after", "ruin")


def equity(executed: DataFrame, cfg: Config, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """seq 0 with the initial balance, then the balance after each trade; with running peak and drawdown."""
    rows = executed.select(*by, "seq", F.col("saldo_despues").alias("equity"))
    start = executed.select(*by).distinct().withColumns({"seq": F.lit(0).cast("long"), "equity": F.lit(cfg.saldo_inicial)})
    w = W.partitionBy(*by).orderBy("seq")
    run = rows.unionByName(start).withColumn("peak", F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.withColumns({"drawdown": F.col("peak") - F.col("equity"), "drawdown_pct": safe_div(100.0 * (F.col("peak") - F.col("equity")), F.col("peak"), 0.0), "delta": F.col("equity") - F.lag("equity").over(w)})
