"""The nearest-bar query takes every tick as a point."""

from __future__ import annotations

from bisect import bisect_left
from datetime import datetime, timedelta

from tidemark import queries as Q
from tidemark.operators import bars as B


def test_nearest_snap_covers_every_tick(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, ("a", "b")[i % 3 == 0], start + timedelta(minutes=i * i * 7 % 4001), float(i)) for i in range(1, 90)]
    rows += [(200, "a", start + timedelta(minutes=90), 1.0), (201, "c", start + timedelta(minutes=45), 1.0)]
    events = spark.createDataFrame([(i, i, kind, ts, v, None) for i, kind, ts, v in rows], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for i, kind, ts, _ in rows:
        bars = sorted({t.replace(minute=0) for _, k, t, _ in rows if k == kind})
        at = bisect_left(bars, ts)
        near = min(bars[max(at - 1, 0) : at + 1], key=lambda b: (abs(b - ts), b))
        want.add((kind, ts, i, near))
    got = Q.queries()["nearest_snap"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {(r.symbol, r.timestamp, r.event_id, r.snap_ts) for r in got} == want


def test_nearest_over_days_without_bars_reads_no_frame_again_for_each_row(spark):
    start = datetime(2024, 1, 1)
    bars = [("a", start + timedelta(hours=h)) for h in (5, 29, 30, 400, 401, 1000)] + [(None, start)]
    points = [("a", start + timedelta(hours=h / 2), h) for h in range(0, 2100, 7)] + [("a", None, -1), (None, start, -2), ("b", start, -3)]
    df = B.nearest(spark.createDataFrame(points, "symbol string, timestamp timestamp_ntz, key long"), spark.createDataFrame(bars, "symbol string, timestamp timestamp_ntz"), "key")
    near = {k: None if s != "a" or t is None else min((b for x, b in bars if x == "a"), key=lambda b: (abs(b - t), b)) for s, t, k in points}
    assert {r.key: r.snap_ts for r in df.collect()} == near
    assert "currentrow$(), unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()
