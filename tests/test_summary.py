"""What a run leaves behind: summaries by asset, the best trials' trades."""

from pyspark.sql import functions as F

from tidemark.plans import summary as S


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trial long, saldo_actual double, score double")


def test_parameters_are_columns_and_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "summary")
    first = _metrics(spark, [("A", 0, 310.0, 2.0), ("B", 0, 290.0, 1.0), ("A", 1, 305.0, 3.0), ("B", 1, 300.0, 0.0)])
    trials = [(0, {"k": 5, "kind": "ema", "__meta": 1, "on": True}), (1, {"k": 7.5, "kind": "sma", "on": False})]
    for _ in range(2):
        S.write_summary(first, trials, path, "s1", 0)
    second = _metrics(spark, [("A", 2, 400.0, 9.0)])
    S.write_summary(second, [(2, {"other": "x"})], path, "s1", 1)
    rows = S.read_summary(spark, path).collect()
    assert [(r.asset, r.trial) for r in rows] == [("A", 2), ("A", 0), ("A", 1), ("B", 1), ("B", 0)]
    by = {(r.asset, r.trial): r for r in rows}
    assert (by["A", 1].param_k, by["A", 0].param_kind, by["B", 0].param_on, by["A", 2].param_other, by["A", 0].param_other) == (7.5, "ema", True, "x", None)
    assert "param___meta" not in rows[0].asDict()
    assert [r.trial for r in S.read_summary(spark, path, "B").collect()] == [1, 0]


def test_the_folder_equals_the_top_k_over_all_batches(spark, tmp_path):
    path = str(tmp_path / "best")
    scores = {("A", 0): 1.0, ("A", 1): 5.0, ("A", 2): 3.0, ("A", 3): 5.0, ("A", 4): 0.5, ("B", 0): 2.0, ("B", 3): 1.0, ("B", 4): 7.0}
    for batch in ([0, 1], [2, 3], [2, 3], [4]):  # one is repeated
        own = [(s, t, 0.0, x) for (s, t), x in scores.items() if t in batch]
        trades = spark.createDataFrame([(s, t, i, x) for s, t, _, x in own for i in range(3)], "symbol string, trial long, seq int, pnl double")
        S.keep_best(trades, _metrics(spark, own), path, "s", 2)
    assert sorted((r.symbol, r.trial) for r in S.best_kept(spark, path).collect()) == [("A", 1), ("A", 3), ("B", 0), ("B", 4)]
    kept = spark.read.parquet(f"{path}/trades").groupBy("symbol", "trial").agg(F.count("*").alias("n"), F.max("pnl").alias("p")).collect()
    assert sorted((r.symbol, r.trial, r.n, r.p) for r in kept) == [("A", 1, 3, 5.0), ("A", 3, 3, 5.0), ("B", 0, 3, 2.0), ("B", 4, 3, 7.0)]
