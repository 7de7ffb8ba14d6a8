"""Resampling, auditing and aligning bars."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import is_true

OHLCV = ("open", "high", "low", "close", "volume")


def series(*by: str, order: str = "timestamp"):
    """The window of one series in time order."""
    return W.partitionBy(*(by or ("symbol",))).orderBy(order)


def indexed(bars: DataFrame, *by: str) -> DataFrame:
    """Number each series' bars from 0."""
    return bars.withColumn("bar_idx", (F.row_number().over(series(*by)) - 1).cast("long"))


def ticks_to_bars(ticks: DataFrame, every: str) -> DataFrame:
    """symbol, timestamp (left edge), open, high, low, close, volume; pre-aggregated before the shuffle."""
    at = F.struct("timestamp", "tie")
    made = ticks.groupBy("symbol", F.window("timestamp", every).alias("bin")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return made.select("symbol", F.col("bin.start").alias("timestamp"), *OHLCV)


def resample(bars: DataFrame, every: str) -> DataFrame:
    """Larger bars from smaller ones: closed and labelled left, without those lacking a price."""
    made = bars.groupBy("symbol", F.window("timestamp", every).alias("bin")).agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
    return made.select("symbol", F.col("bin.start").alias("timestamp"), *OHLCV).dropna(subset=["open", "high", "low", "close"])


def generate(bars: DataFrame, minutes: int = 5, targets: tuple[str, ...] = ("15 minutes", "1 hour")) -> dict[str, DataFrame]:
    """Validated base bars and their resamplings; series whose median step is off by a fifth are left out."""
    good = median_step(bars, minutes * 60).where("ok").select("symbol")
    base = bars.join(good, "symbol", "left_semi")
    return {f"{minutes} minutes": base} | {every: resample(base, every) for every in targets}


def steps(bars: DataFrame) -> DataFrame:
    """Add ``dsec``, the whole seconds since the bar before."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    return bars.withColumn("dsec", F.try_divide(at - F.lag(at).over(series()), F.lit(1_000_000)).cast("long"))


def nearest_quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles that are values themselves: that at round((n - 1) p). Counts of distinct values replace a collected list."""
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = W.partitionBy(by).orderBy(value)
    placed = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy(by)))
    pick = {name: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * F.lit(p) + 0.5), F.col(value))) for name, p in shares.items()}
    return placed.groupBy(by).agg(*[c.alias(name) for name, c in pick.items()])


def audit(bars: DataFrame, expected_seconds: int) -> DataFrame:
    """For each symbol: rows, dup_ts, dsec_min/p50/p90/max, gaps_gt_1_5x, min_ts, max_ts."""
    stepped = steps(bars)
    base = stepped.groupBy("symbol").agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("timestamp")).alias("dup_ts"), F.count_if(F.col("dsec") > 1.5 * expected_seconds).alias("gaps_gt_1_5x"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))
    return base.join(nearest_quantiles(stepped, "symbol", "dsec", {"dsec_min": 0.0, "dsec_p50": 0.5, "dsec_p90": 0.9, "dsec_max": 1.0}), "symbol", "left")


def median_step(bars: DataFrame, expected_seconds: int) -> DataFrame:
    """symbol, median_sec, ok: within a fifth of what is expected; null and false for fewer than three bars."""
    stepped = steps(bars)
    n = stepped.groupBy("symbol").agg(F.count("*").alias("n"))
    both = n.join(nearest_quantiles(stepped, "symbol", "dsec", {"m": 0.5}), "symbol", "left")
    median = F.when(F.col("n") >= 3, F.col("m").cast("double"))
    return both.select("symbol", median.alias("median_sec"), is_true(median.between(0.8 * expected_seconds, 1.2 * expected_seconds)).alias("ok"))


def dedup(bars: DataFrame, tie: Column) -> DataFrame:
    """One row for each (symbol, timestamp): the first by ``tie``."""
    w = W.partitionBy("symbol", "timestamp").orderBy(tie)
    return bars.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def asof_align(base: DataFrame, signals: DataFrame, carry: list[str], lookahead: str = "safe", every: str = "1 hour") -> DataFrame:
    """Give each base bar the carried columns of the last signal bar at or before it.

    Both sides go into one stream ordered by time, signals first on ties: one shuffle, no join.
    "safe" counts a signal bar only once it has closed, one bar later; "reference" counts it
    from its left edge on. Booleans are false where no signal came before.
    """
    at = F.col("timestamp") + F.expr(f"interval {every}") if lookahead == "safe" else F.col("timestamp")
    extra = F.struct(*carry)
    left = base.select("*", F.lit(1).alias("_side"), F.lit(None).cast(signals.select(extra.alias("c")).schema["c"].dataType).alias("_row"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in base.dtypes if c not in ("symbol", "timestamp")]
    right = signals.select("symbol", at.alias("timestamp"), *nothing, F.lit(0).alias("_side"), extra.alias("_row")).select(*left.columns)
    w = W.partitionBy("symbol").orderBy("timestamp", "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    kinds = dict(signals.dtypes)
    return filled.select(*base.columns, *[(is_true(F.col(f"_row.{c}")) if kinds[c] == "boolean" else F.col(f"_row.{c}")).alias(c) for c in carry])


def nearest(points: DataFrame, bars: DataFrame, key: str) -> DataFrame:
    """For each point (symbol, timestamp, ``key``) the nearest bar's time as ``snap_ts``; ties go to the earlier.

    Both sides meet day by day; a day's last bar before it and first bar after it come from a table of days.
    """
    both = points.select("symbol", "timestamp", key, F.lit(1).alias("_side"), F.lit(None).cast("timestamp_ntz").alias("bar_ts")).unionByName(bars.select("symbol", "timestamp", F.lit(None).cast(dict(points.dtypes)[key]).alias(key), F.lit(0).alias("_side"), F.col("timestamp").alias("bar_ts")))
    both = both.withColumn("_day", F.to_date("timestamp"))
    ends = both.where("_day is not null").groupBy("symbol", "_day").agg(F.min("bar_ts").alias("first"), F.max("bar_ts").alias("last"))
    # Frames that end at the row: those that begin there are summed anew for every row.
    past, to_come = W.partitionBy("symbol").orderBy("_day").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("symbol").orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)
    days = ends.select("symbol", "_day", F.max("last").over(past).alias("day_before"), F.min("first").over(to_come).alias("day_after"))
    back = W.partitionBy("symbol", "_day").orderBy("timestamp", "_side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("symbol", "_day").orderBy(F.desc("timestamp"), "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("before", F.last("bar_ts", ignorenulls=True).over(back)).withColumn("after", F.last("bar_ts", ignorenulls=True).over(ahead)).where("_side = 1")
    found = found.join(days, ["symbol", "_day"], "left").withColumns({"before": F.coalesce("before", "day_before"), "after": F.coalesce("after", "day_after")})
    gap = lambda a, b: F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))
    later = F.col("before").isNull() | (gap("timestamp", "after") < gap("before", "timestamp"))
    snap = F.when(later & F.col("after").isNotNull(), F.col("after")).otherwise(F.col("before"))
    return found.select("symbol", "timestamp", key, F.when(F.col("symbol").isNotNull(), snap).alias("snap_ts"))


# --- timeframe names -------------------------------------------------------


_SPAN = re.compile(r"(\d+(?:\.\d+)?)\s*([mh]?)")
_UNIT = {"": 1, "m": 1, "h": 60}


def _span(value) -> tuple[int, str] | None:
    """(minutes, unit as given) of 5, "5", "5m" or "2h"; None for what isn't one of these."""
    found = None if isinstance(value, bool) else _SPAN.fullmatch(str(value).strip().lower())
    return found and (int(float(found[1]) * _UNIT[found[2]]), found[2])


def timeframe_suffix(value) -> str:
    """A timeframe's name: minutes ("5m"), one hour always "1h", hours given as such ("2h"); "1h" for what can't be read."""
    minutes, unit = _span(value) or (60, "h")
    return f"{minutes // 60}h" if minutes == 60 or (unit == "h" and minutes % 60 == 0) else f"{minutes}m"


def suffix_minutes(suffix: str) -> int:
    """Minutes of a timeframe's name; "2h" is 120. Raises ValueError for what can't be read."""
    if not (found := _span(suffix)):
        raise ValueError(f"no timeframe: {suffix!r}")
    return found[0]


def warmup_in(bars: int, from_tf: str, to_tf: str) -> int:
    """Warm-up bars of one timeframe as bars of another, rounded up."""
    return math.ceil(max(bars, 0) * suffix_minutes(from_tf) / suffix_minutes(to_tf))


def timeframes(value) -> list[str]:
    """Names of one timeframe or of several (a list, or separated by commas), each once, in the order given."""
    raw = value if isinstance(value, list | tuple) else str(value).split(",")
    return list(dict.fromkeys(timeframe_suffix(v) for v in raw if str(v).strip()))
