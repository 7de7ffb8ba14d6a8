"""Texts that share an id and a 32-bit hash stay apart in the operators that remove repeated spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.debruijn_dedup import substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup


def test_rows_with_null_ids_and_one_short_hash(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(20))
    text = F.concat(F.lit("n"), F.col("id"), F.lit(" "), F.when(F.col("id") % 2 == 0, F.lit(other)).otherwise(F.lit(f"{passage} {passage}")))
    made = spark.range(400000).select(text.alias("text"))
    pair = made.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where("size(t) > 1 and least(length(t[0]), length(t[1])) < 200 and greatest(length(t[0]), length(t[1])) > 200").first().t
    for run in (suffix_dedup, substring_dedup):
        got, want = ([sorted(tuple(r)[1:] for r in run(spark.createDataFrame(rows, "doc_id long, text string")).collect()) for rows in ([(None, t) for t in pair], list(enumerate(pair)))])
        assert got == want
        assert sorted(r[1] > 0 for r in got) == [False] * (len(pair) - 1) + [True]
