"""Non-overlapping selection and first hits against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection as S
from tidemark.operators import trades as T


def _greedy(rows):
    free, out = -1, []
    for entry, stop in sorted(rows):
        if entry > free:
            out.append(entry)
            free = stop
    return out


@pytest.mark.parametrize("short", [0, 4096])
def test_chains_equal_the_greedy_loop(spark, short):
    rng, rows = random.Random(5), []
    for key in "abc":
        entries = sorted(rng.sample(range(600), 150))
        rows += [(key, e, e + rng.choice([1, 1, 2, 3, 40, 300])) for e in entries]
    rows += [("d", 7, 9), ("e", 0, 0), ("e", 1, 1), ("e", 2, 10_000)]
    df = spark.createDataFrame(rows, "symbol string, entry_idx long, free long")
    got = S.chosen(df, ("symbol",), short).orderBy("symbol", "seq").collect()
    for key in "abcde":
        own = [r for r in got if r.symbol == key]
        assert [r.entry_idx for r in own] == _greedy([(e, f) for k, e, f in rows if k == key])
        assert [r.seq for r in own] == list(range(1, len(own) + 1))


def test_successors_cross_blocks(spark):
    rows = [("a", e, f) for e, f in [(0, 3), (5, 6), (90, 95), (91, 400), (950, 960)]]
    df = spark.createDataFrame(rows, "symbol string, entry_idx long, free long")
    got = {r.node: r.jump for r in S.successors(df, ("symbol",), block=10).collect()}
    assert got == {0: 5, 5: 90, 90: 950, 91: 950}


def test_no_candidates(spark):
    df = spark.createDataFrame([], "symbol string, entry_idx long, free long")
    assert S.chosen(df, ("symbol",)).isEmpty() and S.chosen(df, ("symbol",), 0).isEmpty()


def _walk(bars, entry, long, sl, tp, act, dist, trailing):
    """The rules bar by bar, with real prices."""
    sign = 1 if long else -1
    best = sign * bars[entry][3]
    for j in range(entry + 1, len(bars)):
        o, h, low, _ = bars[j]
        fav, adv = (h, low) if long else (-low, -h)
        before, best = best, max(best, fav)
        if adv <= sl:
            return j, "SL", sign * min(sign * o, sl)
        if trailing and best >= act and adv <= best - dist:
            return j, "TRAILING_STOP", sign * (min(sign * o, best - dist) if before >= act else best - dist)
        if fav >= tp:
            return j, "TP", sign * tp
    return len(bars) - 1, "END_OF_DATA", bars[-1][3]


@pytest.mark.parametrize("trailing", [False, True])
def test_exits_over_three_levels(spark, trailing):
    rng, price, bars = random.Random(11), 100.0, []
    for _ in range(64 * 64 + 900):  # three levels
        close = price + rng.gauss(0, 0.15)
        bars.append((price, max(price, close) + abs(rng.gauss(0, 0.05)), min(price, close) - abs(rng.gauss(0, 0.05)), close))
        price = close
    rows = [("a", i, *b) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double")
    df = df.withColumn("timestamp", F.timestamp_seconds(F.col("bar_idx") * 3600).cast("timestamp_ntz"))
    picks = sorted(rng.sample(range(len(bars) - 1), 60))
    entries = [("a", "long" if i % 2 else "short", e, bars[e][3], len(bars) - 1, 1.0, rng.choice([1.0, 4.0, 9.0, 60.0])) for i, e in enumerate(picks)]
    sized = spark.createDataFrame(entries, "symbol string, type string, entry_idx long, entry_price double, end_idx long, qty double, sl_pct double")
    sized = sized.withColumns({"saldo_usado": F.lit(100.0), "tp_pct": F.col("sl_pct") * 1.5, "trail_act_pct": F.col("sl_pct") / 2, "trail_dist_pct": F.col("sl_pct") / 4, "trailing": F.lit(trailing)})
    got = {r.entry_idx: r for r in T.exits(sized, df).collect()}
    ends = set()
    for _, side, e, p, _, _, pct in entries:
        sign = 1 if side == "long" else -1
        want = _walk(bars, e, side == "long", sign * p - pct, sign * p + pct * 1.5, sign * p + pct / 2, pct / 4, trailing)
        assert (got[e].exit_idx, got[e].tipo_salida) == want[:2] and abs(got[e].exit_price - want[2]) < 1e-9
        ends.add(want[1])
    assert "END_OF_DATA" in ends and len(got) == len(entries)
