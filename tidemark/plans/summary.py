"""Tables that a run leaves behind: a summary by asset with parameters as columns, and the trades of the best trials.

Both are partitioned folders of which a write replaces only its own partitions, by Spark's own commit. So
a batch that is written again leaves the same rows, and one that fails leaves none.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.search import reported


def with_parameters(metrics: DataFrame, trials: list[tuple[int, dict[str, Any]]], prefix: str = "param_") -> DataFrame:
    """Add each trial's reported parameters as columns: numbers as doubles, truth values as booleans, all else as text."""
    shown = {number: reported(params) for number, params in trials}
    names = sorted({name for own in shown.values() for name in own})
    raw = {number: {k: v for k, v in params.items()} for number, params in trials}
    kind = {n: "double" if all(isinstance(raw[t].get(n), (int, float)) and not isinstance(raw[t].get(n), bool) for t in raw if n in shown[t]) else "boolean" if all(isinstance(raw[t].get(n), bool) for t in raw if n in shown[t]) else "string" for n in names}
    value = lambda t, n: None if n not in shown[t] else float(raw[t][n]) if kind[n] == "double" else raw[t][n] if kind[n] == "boolean" else shown[t][n]
    schema = ", ".join(["trial long", *(f"`{prefix}{n}` {kind[n]}" for n in names)])
    table = metrics.sparkSession.createDataFrame([(t, *(value(t, n) for n in names)) for t in shown], schema)
    return metrics.join(F.broadcast(table), "trial", "left")  # a row for each trial of the batch


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_summary(metrics: DataFrame, trials: list[tuple[int, dict[str, Any]]], path: str, study: str, batch: int) -> None:
    """One folder for each asset; a repeated (study, batch) takes the place of the first."""
    rows = with_parameters(metrics, trials).withColumnRenamed("symbol", "asset").withColumns({"study": F.lit(study), "batch": F.lit(batch)})
    _replace(rows.repartition("asset"), path, "asset", "study", "batch")


def read_summary(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """The rows of all batches, columns of any; best final balance first. Files of other assets are not read."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    rows = rows if asset is None else rows.where(F.col("asset") == asset)
    return rows.orderBy(F.desc_nulls_last("saldo_actual"), F.desc_nulls_last("score"), "study", "trial")


def best_kept(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, study, trial, score) of the trials whose trades are kept."""
    return spark.read.parquet(f"{path}/index")


def keep_best(executed: DataFrame, metrics: DataFrame, path: str, study: str, k: int) -> DataFrame:
    """Merge a batch's trades with those kept: the ``k`` best trials of each symbol stay, by score, earlier ones on ties.

    Only trades of newly kept trials are written and only displaced ones removed; the index, a row for each kept trial, is
    written last, under a new name that takes the old one's place, so a batch that dies is simply repeated.
    """
    spark = executed.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(hadoop.Path(f"{path}/index"))
    new = metrics.where("score is not null").select("symbol", F.lit(study).alias("study"), F.col("trial").cast("long").alias("trial"), "score")
    held = best_kept(spark, path).select(*new.columns) if there else new.limit(0)
    # A repeated batch takes the place of its own trials.
    both = held.join(new.select("symbol", "study", "trial"), ["symbol", "study", "trial"], "left_anti").select(*new.columns).unionByName(new)
    order = W.partitionBy("symbol").orderBy(F.desc("score"), "study", "trial")
    kept = [tuple(r) for r in both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*new.columns).collect()]  # k a symbol
    index = spark.createDataFrame(kept, new.schema)
    fresh = executed.withColumn("study", F.lit(study)).join(F.broadcast(index.select("symbol", "study", "trial")), ["symbol", "study", "trial"], "left_semi")
    _replace(fresh.repartition("symbol", "trial"), f"{path}/trades", "symbol", "study", "trial")
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index-new")
    names = {(s, st, t) for s, st, t, _ in kept}
    gone = [tuple(r)[:3] for r in (held.collect() if there else []) if tuple(r)[:3] not in names]
    files.delete(hadoop.Path(f"{path}/index"), True)
    files.rename(hadoop.Path(f"{path}/index-new"), hadoop.Path(f"{path}/index"))
    for symbol, own, trial in gone:
        files.delete(hadoop.Path(f"{path}/trades/symbol={symbol}/study={own}/trial={trial}"), True)
    return best_kept(spark, path)
