"""The join with counted keys against a plain one."""

from __future__ import annotations

from collections import Counter

from tidemark.llm import skew


def test_join_counted_with_hot_null_and_lone_keys(spark):
    keys = [7] * 600 + [8] * 40 + [None] * 30 + list(range(100, 400)) * 2 + [9]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, at long")
    counts = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n").where("n > 1").withColumn("extra", -rows.key)
    got = skew.join_counted(rows, counts, "key", "at")
    assert got.columns == ["key", "at", "extra"]
    n = Counter(k for k in keys if k is not None)
    want = sorted((k, i, -k) for i, k in enumerate(keys) if k is not None and n[k] > 1)
    assert sorted(map(tuple, got.collect())) == want


def test_join_counted_of_empty_tables(spark):
    rows = spark.createDataFrame([], "key long, at long")
    counts = spark.createDataFrame([], "key long, n long")
    assert skew.join_counted(rows, counts, "key", "at").collect() == []
