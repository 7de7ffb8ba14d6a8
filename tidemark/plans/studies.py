"""Studies of several assets and strategies, several at a time, over one table of trials.

A study is an asset, a strategy and an exit type. It asks its sampler for a batch, runs the batch as
one set of Spark jobs, and tells the table. The table is all that a study knows: whoever
starts it again goes on behind its last whole batch. Studies run as concurrent jobs, each in a
scheduler pool of its own; their results don't depend on how many run at once. A batch replaces its own partition of the
table, so a repeated batch leaves the same rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import trades as T
from tidemark.plans.search import both_exit_types, exit_space, quantity_space, reported, run_trials, sample, study_name, tpe
from tidemark.plans.strategies import Strategy
from tidemark.sources.bars import ALIASES

#: The asset where none is named, and the score of a failed trial (fixed values).
DEFAULT_ASSET, FAILED = "GOLD", -9999.0
#: Target quantities of assets and their ranges where none is known (fixed values).
DEFAULT_QTY, DEFAULT_RANGE = 3.0, (0.01, 5.0, 0.01)
TRIALS = "study string, asset string, strategy string, exit_type string, batch int, trial long, state string, score double, params map<string,string>, told string, error string"


def asset_name(text: object, aliases: dict[str, str] = ALIASES) -> str:
    upper = str(text).strip().upper()
    return aliases.get(upper, upper)


def assets(given: object, aliases: dict[str, str] = ALIASES) -> list[str]:
    """Asset names in upper case from a list or a text with commas; short names spelt out, empty ones left out."""
    parts = given if isinstance(given, (list, tuple)) else str(given).split(",")
    return [asset_name(p, aliases) for p in parts if str(p).strip()] or [DEFAULT_ASSET]


@dataclass(frozen=True)
class Asset:
    """What one asset trades: its symbol among the bars, its target quantity, and the quantity's range if that is searched too."""

    symbol: str
    qty: float = DEFAULT_QTY
    qty_range: tuple[float, float, float] | None = None


def quantities(names: Iterable[str], qty: dict[str, float], ranges: dict[str, tuple[float, float, float]] | None = None) -> dict[str, Asset]:
    """An ``Asset`` for each name; with ``ranges`` (an empty one will do) the quantity is searched as well."""
    return {n: Asset(n, float(qty.get(n, DEFAULT_QTY)), None if ranges is None else tuple(ranges.get(n, DEFAULT_RANGE))) for n in names}


@dataclass(frozen=True)
class Study:
    asset: Asset
    strategy: Strategy
    cfg: T.Config

    @property
    def name(self) -> str:
        return study_name(self.asset.symbol, self.strategy.name, self.cfg.exit_type)

    @property
    def seed(self) -> int:
        """The same for a study wherever and whenever it runs."""
        return int.from_bytes(hashlib.blake2b(self.name.encode(), digest_size=4).digest())

    def extra(self, optimise_exits: bool) -> dict[str, Any]:
        own = exit_space(self.cfg.exit_type) if optimise_exits else {}
        return own | (quantity_space(*self.asset.qty_range) if self.asset.qty_range else {})


def studies_of(things: Iterable[Asset], strategies: Iterable[Strategy], cfg: T.Config) -> list[Study]:
    """Every asset with every strategy and exit type, each with its asset's quantity."""
    strategies = list(strategies)
    return [Study(a, s, replace(c, qty=a.qty)) for a in things for s in strategies for c in both_exit_types(cfg)]


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """All trials told so far; no rows where there is no table yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], TRIALS)
    return spark.read.schema(TRIALS).parquet(path)


def _tell(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Write a batch over what its partition holds; other batches stay."""
    frame = spark.createDataFrame(rows, TRIALS).coalesce(1)
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("study", "batch").parquet(path)


def _told(spark: SparkSession, path: str, study: Study) -> list[tuple[dict, float, str]]:
    rows = read_trials(spark, path).where(F.col("study") == study.name).orderBy("trial").select("told", "score", "state").collect()
    return [(json.loads(r.told), r.score, r.state) for r in rows]


def _run(bars: DataFrame, study: Study, trials: list[tuple[int, dict]]) -> dict[int, tuple[str, float, str | None]]:
    """State, score and error of each trial. One that fails alone fails alone: the batch is then run trial by trial."""
    try:
        metrics, _ = run_trials(bars, study.strategy, trials, study.cfg)
        found = {r.trial: (r.n, r.score) for r in metrics.groupBy("trial").agg(F.sum("n_trades").alias("n"), F.avg("score").alias("score")).collect()}
        return {n: ("complete" if found[n][0] else "empty", found[n][1], None) for n, _ in trials}
    except Exception as error:  # noqa: BLE001  whatever a strategy raises ends its trial, not the study
        if len(trials) == 1:
            return {trials[0][0]: ("failed", FAILED, f"{type(error).__name__}: {error}"[:500])}
        return {n: x for t in trials for n, x in _run(bars, study, [t]).items()}


def run_study(bars: DataFrame, study: Study, n_trials: int, path: str, batch: int = 32, sampler: str = "tpe", optimise_exits: bool = True, given: list[dict] | None = None) -> None:
    """Ask, run and tell until the table has ``n_trials`` trials of the study. ``given``: parameter sets in place of a sampler's."""
    spark, extra = bars.sparkSession, study.extra(optimise_exits)
    own = bars.where(F.col("symbol") == study.asset.symbol)
    told = _told(spark, path, study)
    while len(told) < n_trials:
        first = len(told)
        n = min(batch, n_trials - first)
        if given is not None:
            asked = given[first : first + n]
        elif sampler == "random":
            asked = sample(study.strategy, n, study.seed + first, extra)
        else:
            asked = tpe(study.strategy, [(p, s) for p, s, state in told if state != "failed"], n, study.seed + first, extra)
        done = _run(own, study, [(first + i, p) for i, p in enumerate(asked)])
        head = (study.name, study.asset.symbol, study.strategy.name, study.cfg.exit_type, first // batch)
        rows = [(*head, first + i, done[first + i][0], done[first + i][1], reported(p), json.dumps(p), done[first + i][2]) for i, p in enumerate(asked)]
        _tell(spark, path, rows)
        told += [(p, done[first + i][1], done[first + i][0]) for i, p in enumerate(asked)]


def run_studies(bars: DataFrame, studies: list[Study], n_trials: int, path: str, at_once: int = 4, **options) -> DataFrame:
    """Run all studies, ``at_once`` at a time, each in its own scheduler pool; the table of their trials.

    ``bars`` is read by every study: hand over bars that are written or cheap to derive.
    """
    spark = bars.sparkSession
    context = spark.sparkContext

    def one(study: Study) -> None:
        context.setLocalProperty("spark.scheduler.pool", study.name)
        try:
            run_study(bars, study, n_trials, path, **options)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(one), s) for s in studies]:
            done.result()
    return read_trials(spark, path).where(F.col("study").isin([s.name for s in studies]))
