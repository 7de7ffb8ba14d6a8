"""Sampling parameter sets on the driver and running them as Spark jobs.

Rows of all trials of a batch go through the operators together, keyed by (symbol, trial);
signals that several trials share, because only exits or sizes differ, are computed once.
"""

from __future__ import annotations

import math
import random
import re
import statistics
from collections.abc import Callable, Iterable
from dataclasses import replace
from itertools import product
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import trades as T
from tidemark.plans.strategies import Choice, Float, Int, Strategy
from tidemark.session import cut

#: Ranges of the engine's own exits (fixed values): low, high, step.
EXIT_SPACE = {"exit_sl_pct": Float(15.0, 30.0, 2.5), "exit_tp_pct": Float(15.0, 80.0, 2.5), "exit_trail_act_pct": Float(10.0, 65.0, 2.5), "exit_trail_dist_pct": Float(2.5, 25.0, 2.5)}


def values(kind: Any) -> list:
    """All values of a stepped range or choice."""
    if isinstance(kind, Choice):
        return list(kind.values)
    if isinstance(kind, Float) and kind.step is None:
        raise ValueError("a range without step has no grid")
    count = int(math.floor((kind.high - kind.low) / kind.step + 1e-9)) + 1
    return [kind.low + i * kind.step for i in range(count)]


def _draw(kind: Any, rng: random.Random):
    return rng.uniform(kind.low, kind.high) if isinstance(kind, Float) and kind.step is None else rng.choice(values(kind))


def exit_space(exit_type: str) -> dict[str, Any]:
    return EXIT_SPACE if exit_type in {"pnl_trailing", "all"} else {k: v for k, v in EXIT_SPACE.items() if "trail" not in k}


def sample(strategy: Strategy, n: int, seed: int = 0, extra: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """n seeded random parameter sets; a bound may depend on values drawn before it."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        chosen: dict[str, Any] = {}
        for name in [*strategy.space({}), *(extra or {})]:
            chosen[name] = _draw((strategy.space(chosen) | (extra or {}))[name], rng)
        out.append(chosen)
    return out


def grid(space: dict[str, Any]) -> Iterable[dict[str, Any]]:
    names = list(space)
    return (dict(zip(names, v, strict=True)) for v in product(*(values(space[n]) for n in names)))


def tpe(strategy: Strategy, told: list[tuple[dict[str, Any], float]], n: int, seed: int = 0, extra: dict[str, Any] | None = None, good: float = 0.15, tries: int = 24) -> list[dict[str, Any]]:
    """Next sets by a tree-structured Parzen estimator: of drawn sets those likeliest under the best told against the rest."""
    if len(told) < 10:
        return sample(strategy, n, seed, extra)
    rng = random.Random(seed)
    ranked = [p for p, _ in sorted(told, key=lambda t: -t[1])]
    cut_at = max(2, int(len(ranked) * good))
    best, rest = ranked[:cut_at], ranked[cut_at:]

    def density(x, kind, seen):
        if isinstance(kind, Choice):
            return (sum(s == x for s in seen) + 1) / (len(seen) + len(kind.values))
        span = max(kind.high - kind.low, 1e-9)
        spread = statistics.pstdev(seen) if len(seen) > 1 else span
        width = max(1.06 * spread * max(len(seen), 1) ** -0.2, span / 100)
        near = sum(math.exp(-0.5 * ((x - s) / width) ** 2) for s in seen) / (width * math.sqrt(2 * math.pi))
        return (near + 1 / span) / (len(seen) + 1)  # one more, flat over the range

    def gain(p):
        space = strategy.space(p) | (extra or {})
        return sum(math.log(density(p[k], v, [b[k] for b in best if k in b]) / density(p[k], v, [r[k] for r in rest if k in r])) for k, v in space.items())

    drawn = sample(strategy, n * tries, rng.randrange(1 << 30), extra)
    near = []
    for p in drawn[::2]:  # half of the sets start from a good one, with some values drawn anew
        base = rng.choice(best) | {k: v for k, v in p.items() if rng.random() < 0.3}
        space = strategy.space(base) | (extra or {})
        near.append({k: p[k] if not isinstance(v, Choice) and not v.low <= base[k] <= v.high else base[k] for k, v in space.items()})
    return sorted([*drawn[1::2], *near], key=gain, reverse=True)[:n]


def split_params(params: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """By prefix: metadata (two underscores), exits, and the strategy's own."""
    kind = lambda k: "meta" if k.startswith("__") else "exit" if k.startswith("exit_") else "own"
    return {group: {k: v for k, v in params.items() if kind(k) == group} for group in ("own", "exit", "meta")}


def reported(params: dict[str, Any]) -> dict[str, str]:
    """Parameters as a report shows them: metadata left out, collections as text."""
    flat: dict[str, str] = {}
    for k, v in params.items():
        if k.startswith("__"):
            continue
        flat |= {f"{k}.{i}": str(x) for i, x in v.items()} if isinstance(v, dict) else {k: str(v)}
    return flat


def study_name(*parts: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", "_".join(parts).lower()).strip("_")


def _decided(strategy: Strategy, params: dict[int, dict[str, Any]], cfg: T.Config) -> T.Decide:
    """A strategy's own exits, each trial with its parameters. Candidates of different trials share their bars."""

    def decide(candidates: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for trial, own in candidates.groupby("trial"):
            made = strategy.decide_exit(own.reset_index(drop=True), near, params[int(trial)], cfg.saldo_inicial)
            parts.append(made.set_axis(own.index))
        return pd.concat(parts).reindex(candidates.index)

    return decide


def run_trials(bars: DataFrame, strategy: Strategy, trials: list[tuple[int, dict[str, Any]]], cfg: T.Config) -> tuple[DataFrame, DataFrame]:
    """(metrics and score for each symbol and trial, executed trades). Symbols without trades score 0."""
    spark, by = bars.sparkSession, ("symbol", "trial")
    bars = cut(bars)  # read by every set of signals, every round of exits, and the period
    groups: dict[str, list[int]] = {}
    settings, shared = [], {}
    for number, params in trials:
        parts = split_params(params)
        key = repr(sorted((k, v) for k, v in parts["own"].items() if k != "qty_max_activo"))
        groups.setdefault(key, []).append(number)
        shared[key] = parts["own"]
        s = T.exit_settings(params, cfg)
        settings.append((number, float(params.get("qty_max_activo", cfg.qty)), s["sl_pct"], s["tp_pct"], s["trail_act_pct"], s["trail_dist_pct"], s["exit_type"] == "pnl_trailing"))
    table = spark.createDataFrame(settings, "trial long, target_qty double, sl_pct double, tp_pct double, trail_act_pct double, trail_dist_pct double, trailing boolean")
    entries = None
    for key, numbers in groups.items():
        found = T.candidates(strategy.signals(bars, shared[key])).withColumn("trial", F.explode(F.array(*[F.lit(n).cast("long") for n in numbers])))
        entries = found if entries is None else entries.unionByName(found)
    sized = T.position_size(entries.join(F.broadcast(table), "trial"), cfg)  # one row for each trial of the batch
    exited = T.exits(sized, bars, by)
    if hasattr(strategy, "decide_exit"):
        exited = T.override_exits(exited, bars, _decided(strategy, dict(trials), cfg), by, before=getattr(strategy, "bars_before", 0), ahead=getattr(strategy, "bars_ahead", 256))
    chosen = T.nonoverlapping(exited, by, cfg.block_bars)
    executed = T.account(chosen, cfg, by)
    ends = bars.groupBy("symbol").agg(F.min("timestamp").alias("period_start"), F.max("timestamp").alias("period_end"))
    period = ends.join(F.broadcast(table.select("trial")), how="cross")
    every = bars.select("symbol").distinct().join(F.broadcast(table.select("trial")), how="cross")
    made = M.with_empty(M.scored(M.summary(executed, cfg, period, by)), every, cfg, by)
    return made, executed


def optimise(
    bars: DataFrame,
    strategy: Strategy,
    n_trials: int,
    cfg: T.Config,
    batch: int = 32,
    seed: int = 0,
    sampler: str = "tpe",
    optimise_exits: bool = True,
    on_batch: Callable[[DataFrame, DataFrame], None] | None = None,
    extra: dict[str, Any] | None = None,
    told_in_order: bool = False,
) -> list[tuple[dict[str, Any], float]]:
    """Ask for a batch, run it as one job, tell its mean scores over symbols, and go on; best first, or as they were told.

    ``extra``: ranges beside the strategy's own, such as ``quantity_space``.
    """
    if sampler not in {"tpe", "random"}:
        raise ValueError(f"unknown sampler: {sampler}")
    extra = (exit_space(cfg.exit_type) if optimise_exits else {}) | (extra or {})
    told: list[tuple[dict[str, Any], float]] = []
    while len(told) < n_trials:
        n = min(batch, n_trials - len(told))
        asked = tpe(strategy, told, n, seed + len(told), extra) if sampler == "tpe" else sample(strategy, n, seed + len(told), extra)
        first = len(told)
        metrics, executed = run_trials(bars, strategy, [(first + i, p) for i, p in enumerate(asked)], cfg)
        if on_batch:
            on_batch(metrics, executed)
        scores = {r.trial: r.s for r in metrics.groupBy("trial").agg(F.avg("score").alias("s")).collect()}
        told += [(p, scores.get(first + i, 0.0)) for i, p in enumerate(asked)]
    return told if told_in_order else sorted(told, key=lambda t: -t[1])


def top_trials(metrics: DataFrame, n: int = 5, failed: float = -9999.0) -> DataFrame:
    return metrics.where(F.col("score").isNotNull() & (F.col("score") != failed)).orderBy(F.col("score").desc(), "symbol", "trial").limit(n)


def best_of_each(metrics: DataFrame, k: int, *by: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), "trial")
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_so_far(metrics: DataFrame, *by: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy("trial").rowsBetween(W.unboundedPreceding, 0)
    return metrics.withColumn("best_score", F.max("score").over(w))


def both_exit_types(cfg: T.Config) -> list[T.Config]:
    """ "all" runs fixed exits, then trailing ones."""
    return [replace(cfg, exit_type=t) for t in ("pnl_fixed", "pnl_trailing")] if cfg.exit_type == "all" else [cfg]


def quantity_space(low: float = 0.01, high: float = 5.0, step: float = 0.01) -> dict[str, Any]:
    """A range of the target quantity, to be sampled beside a strategy's own; a step of 0 draws from all of it."""
    return {"qty_max_activo": Float(low, high, step if step > 0 else None)}


def studies(bars: DataFrame, strategies: Iterable[Strategy], n_trials: int, cfg: T.Config, extra: dict[str, Any] | None = None, **options) -> DataFrame:
    """All strategies with each exit type of ``cfg``: study, strategy, exit_type, trial, state, score, params (names and values as text).

    A trial that made no trade in any symbol has the state "empty" and the score 0, any other "complete". Trials keep the order of their asking.
    """
    rows = []
    for strategy, run in product(strategies, both_exit_types(cfg)):
        told = optimise(bars, strategy, n_trials, run, extra=extra, told_in_order=True, **options)
        rows += [(study_name(strategy.name, run.exit_type), strategy.name, run.exit_type, i, "complete" if score else "empty", score, reported(p)) for i, (p, score) in enumerate(told)]
    return bars.sparkSession.createDataFrame(rows, "study string, strategy string, exit_type string, trial long, state string, score double, params map<string,string>")
