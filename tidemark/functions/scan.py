"""Recurrences and rolling frames over series that lie in many chunks.

A recurrence y[t] = m * y[t - 1] + x[t] maps the state before a chunk to the state
behind it by an affine map. Chunks are scanned side by side from zero; their ends, some hundred times
fewer rows, give what is carried into each chunk, and a row takes that times a power of m. What
is carried over more chunks than change a double is left out, so the ends are split
over tasks as well. Rolling frames get a halo: the last rows of the chunk before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a chunk at most; fewer where powers of m would leave the range of doubles.
CHUNK = 512
_RANGE = 250 * math.log(10)
#: A weight below this beside 1 changes no double.
_NOTHING = 1e-20


def chunk_rows(m: float, most: int = CHUNK) -> int:
    """Rows of a chunk for the multiplier ``m``, which lies above 0 and not above 1."""
    return most if m >= 1 else max(1, min(most, int(_RANGE / -math.log(m))))


def _carried(ends: DataFrame, multipliers: dict[str, float], rows: int, by: tuple[str, ...], most: int) -> DataFrame:
    """(by, _chunk, carried values): what the chunks before leave for each chunk and its ends."""
    back = {name: 1 if m**rows < _NOTHING else math.ceil(math.log(_NOTHING) / (rows * math.log(m))) for name, m in multipliers.items() if m < 1}
    before = W.partitionBy(*by).orderBy("_end").rowsBetween(W.unboundedPreceding, -1)
    summed = ends.withColumns({f"_{name}": F.sum(name).over(before) for name, m in multipliers.items() if m == 1})
    if back:
        spread, w = haloed(summed, max(back.values()), by, "_end", most)
        sums = lambda name, k: F.aggregate(F.collect_list(name).over(w.rowsBetween(-k, -1)), F.lit(0.0), lambda acc, x: acc * multipliers[name] ** rows + x)
        summed = core(spread.withColumns({f"_{name}": sums(name, k) for name, k in back.items()}))
    return summed.select(*by, F.col("_end").alias("_chunk"), *[f"_{name}" for name in multipliers])


def affine_scan(df: DataFrame, terms: dict[str, tuple[Column, float]], by: tuple[str, ...] = ("symbol",), idx: str = "bar_idx", most: int = CHUNK) -> DataFrame:
    """Add, for each name with its (x, m), y[t] = m * y[t - 1] + x[t]; a null x adds nothing. m lies above 0 and not above 1.

    ``idx`` numbers a series' rows from 0 without gaps. A chunk has ``most`` rows, or fewer.
    """
    if not all(0 < m <= 1 for _, m in terms.values()):
        raise ValueError("a multiplier must lie above 0 and not above 1")
    multipliers = {name: m for name, (_, m) in terms.items()}
    rows = min(chunk_rows(m, most) for m in multipliers.values())
    place, chunk = F.col(idx) % rows, F.floor(F.col(idx) / rows)
    power = {name: F.pow(F.lit(m), place) for name, m in multipliers.items()}
    scaled = {name: F.coalesce(x.cast("double"), F.lit(0.0)) * F.pow(F.lit(m), -place) for name, (x, m) in terms.items()}
    # Ends as if every chunk were whole: only the last one isn't, and nothing follows it.
    ends = df.groupBy(*by, chunk.alias("_end")).agg(*[(F.sum(s) * multipliers[name] ** (rows - 1)).alias(name) for name, s in scaled.items()])
    over = W.partitionBy(*by, "_chunk").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn("_chunk", chunk).withColumns({name: F.sum(s).over(over) * power[name] for name, s in scaled.items()})
    joined = local.join(_carried(ends, multipliers, rows, by, most), [*by, "_chunk"], "left")
    whole = {name: F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0.0)) * power[name] * m for name, m in multipliers.items()}
    return joined.withColumns(whole).drop("_chunk", *[f"_{name}" for name in terms])


def ewm(df: DataFrame, means: dict[str, Column], alpha: float | None = None, span: float | None = None, least: int = 1, by: tuple[str, ...] = ("symbol",), idx: str = "bar_idx", most: int = CHUNK) -> DataFrame:
    """Add exponentially weighted means with normalised weights; null where the value is, and until ``least`` values were seen.

    A null moves the weights of what came before it on by one row.
    """
    a = 2.0 / (span + 1.0) if alpha is None else alpha
    columns = [c for c in df.columns if c not in means]
    held = df.withColumns({f"_x_{name}": x.cast("double") for name, x in means.items()})
    known = {name: F.col(f"_x_{name}").isNotNull().cast("double") for name in means}
    terms = {f"_s_{name}": (k, 1.0) for name, k in known.items()} if least > 1 else {}
    if a < 1:
        terms |= {f"_n_{name}": (F.col(f"_x_{name}"), 1.0 - a) for name in means} | {f"_d_{name}": (k, 1.0 - a) for name, k in known.items()}
    weighed = affine_scan(held, terms, by, idx, most) if terms else held
    enough = lambda name: F.col(f"_x_{name}").isNotNull() & (F.col(f"_s_{name}") >= least if least > 1 else F.lit(True))
    value = lambda name: F.col(f"_n_{name}") / F.col(f"_d_{name}") if a < 1 else F.col(f"_x_{name}")
    return weighed.select(*columns, *[F.when(enough(name), value(name)).alias(name) for name in means])


def haloed(df: DataFrame, rows: int, by: tuple[str, ...] = ("symbol",), idx: str = "bar_idx", most: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """Rows with the last ``rows`` before their chunk added as ``_halo``, and a window over chunks.

    Frames that reach back ``rows`` rows at most are the same over this window as over the whole series.
    Drop the added rows behind them with ``core``.
    """
    size = max(most, rows)
    chunk = F.floor(F.col(idx) / size)
    near = F.col(idx) % size >= size - rows
    copies = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = df.withColumn("_halo", F.explode(copies)).withColumn("_chunk", chunk + F.col("_halo"))
    return spread, W.partitionBy(*by, "_chunk").orderBy(idx)


def core(df: DataFrame) -> DataFrame:
    """The rows of ``haloed`` without what was added."""
    return df.where("_halo = 0").drop("_halo", "_chunk")
