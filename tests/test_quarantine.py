"""Files with a wrong step or none are moved aside, numbered where names meet."""

from datetime import datetime, timedelta

import pandas as pd

from tidemark.sources import quarantine as Q


def _write(path, minutes, n=20):
    at = [datetime(2024, 1, 1) + timedelta(minutes=minutes * i) for i in range(n)]
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame({"timestamp": at, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0}).to_parquet(path, coerce_timestamps="us")


def test_bad_files_move_once_and_never_overwrite(spark, tmp_path):
    good, bad, broken = (tmp_path / "ohlcv" / n for n in ("GOLD_ohlcv_1h.parquet", "BTC_ohlcv_1h.parquet", "BTC_ohlcv_15m.csv"))
    _write(good, 60)
    _write(bad, 5)
    broken.write_text("nothing\nhere\n")
    checked = Q.check_files(spark, str(tmp_path), ["gold", "btc"], ["15m", "1h"]).cache()
    told = {(r.asset, r.suffix): (r.ok, r.median_sec) for r in checked.collect()}
    assert told == {("gold", "1h"): (True, 3600.0), ("btc", "1h"): (False, 300.0), ("btc", "15m"): (False, None)}
    first = Q.quarantine(spark, checked, str(tmp_path)).collect()
    assert {r.state for r in first} == {"moved"} and good.exists() and not bad.exists()
    again = Q.quarantine(spark, checked, str(tmp_path)).collect()
    assert {r.state for r in again} == {"gone"}
    _write(bad, 7)  # a second bad file of the same name
    second = Q.quarantine(spark, Q.check_files(spark, str(tmp_path), ["btc"], ["1h"]), str(tmp_path)).collect()
    assert [r.target.rsplit("/", 1)[1] for r in second] == ["BTC_ohlcv_1h__2.parquet"]
    aside = sorted(p.name for p in (tmp_path / "_invalid" / "btc").iterdir())
    assert aside == ["BTC_ohlcv_15m.csv", "BTC_ohlcv_1h.parquet", "BTC_ohlcv_1h__2.parquet"]
