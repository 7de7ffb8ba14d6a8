"""Recurrences over chunks against pandas and plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scan as S


def _bars(spark, n=400, seed=3, symbols="ab"):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        for i, c in enumerate(close.tolist()):
            rows.append((s, i, c, c + abs(rng.normal()), c - abs(rng.normal()), c))
    return spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double")


@pytest.mark.parametrize("m", [1.0, 0.999, 0.9, 0.3, 1e-3])
def test_affine_scan(spark, m):
    df = _bars(spark, 300)
    got = S.affine_scan(df, {"y": (F.col("close"), m)}, most=50).orderBy("symbol", "bar_idx").toPandas()
    for _, own in got.groupby("symbol"):
        y, want = 0.0, []
        for x in own["close"]:
            y = m * y + x
            want.append(y)
        assert np.allclose(own["y"], want, rtol=1e-12)


def test_multiplier_out_of_range(spark):
    with pytest.raises(ValueError, match="multiplier"):
        S.affine_scan(_bars(spark, 3), {"y": (F.col("close"), 1.5)})


def test_ewm_with_nulls_in_eight_chunks(spark):
    df = _bars(spark).withColumn("x", F.when(F.col("bar_idx") % 7 != 3, F.col("close")))
    got = S.ewm(df, {"e": F.col("x")}, alpha=0.2, least=9, most=50).orderBy("symbol", "bar_idx").toPandas()
    for _, own in got.groupby("symbol"):
        want = own["x"].astype(float).ewm(alpha=0.2, min_periods=9).mean().where(own["x"].notna())
        assert np.allclose(own["e"].astype(float), want, equal_nan=True, rtol=1e-12)


def test_adx_is_the_same_in_chunks(spark):
    df = _bars(spark)
    one, eight = (I.adx(df, 14, 14, chunk=c).orderBy("symbol", "bar_idx").toPandas()["adx"].astype(float) for c in (10_000, 50))
    assert one.notna().sum() > 700 and np.allclose(one, eight, equal_nan=True, rtol=1e-10)


@pytest.mark.parametrize("chunk", [10_000, 16])
def test_atr_wilder(spark, chunk):
    got = I.atr_wilder(_bars(spark, 120), 14, chunk=chunk).orderBy("symbol", "bar_idx").toPandas()
    for _, own in got.groupby("symbol"):
        before = own["close"].shift()
        tr = pd.concat([own["high"] - own["low"], (own["high"] - before).abs(), (own["low"] - before).abs()], axis=1).max(axis=1).tolist()
        want = [np.nan] * 13 + [sum(tr[:14]) / 14]
        for x in tr[14:]:
            want.append((want[-1] * 13 + x) / 14)
        assert np.allclose(own["atr"].astype(float), want, equal_nan=True, rtol=1e-12)


def test_halo_keeps_rolling_frames(spark):
    df = _bars(spark)
    spread, w = S.haloed(df, 19, most=50)
    got = S.core(spread.withColumn("m", I.sma(F.col("close"), w, 20))).orderBy("symbol", "bar_idx").toPandas()["m"]
    want = df.withColumn("m", I.sma(F.col("close"), S.W.partitionBy("symbol").orderBy("bar_idx"), 20)).orderBy("symbol", "bar_idx").toPandas()["m"]
    assert np.allclose(got.astype(float), want.astype(float), equal_nan=True)
