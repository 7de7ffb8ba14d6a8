"""Every pipeline stage on rows without an id, repeated ids, clashing columns, and on an empty table."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import table
from tidemark.llm.store import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    whole = table(spark, SF, "documents")
    texts = [f"{w} is a word of its own and so on it goes {w} and {w} until the end of {w}" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7001, texts[2]), (7001, texts[3]), (7002, None), (7003, ""), (None, None)]
    added = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], whole.schema)
    return whole.union(added).withColumns({"row": F.lit("clash"), "rep": F.lit(1), "size": F.lit("x"), "key": F.lit(None).cast("string"), "copies": F.lit(9)}), texts


def test_odd_rows_pass_every_stage(spark, docs):
    import corpus_pipeline as C

    now, texts = docs
    for name, stage in C.STAGES[:4]:
        before = now
        now = materialize(stage(spark, now, SF))
        assert now.columns == before.columns
        found = now.where(F.col("text").isin(texts)).groupBy("text").count().collect()
        times = {r.text: r["count"] for r in found}
        if name == "language_id":
            assert times == {texts[0]: 2, texts[1]: 1, texts[2]: 1, texts[3]: 1}
            assert now.where("text is null or text = ''").isEmpty()
        elif name != "mixing":
            # One of the two equal rows goes; texts that differ stay, with one id or none.
            assert times == dict.fromkeys(texts, 1)
    assert C.token_ids(spark, now, SF).count() > 0


def test_empty_table_passes_every_stage(spark, docs):
    import corpus_pipeline as C

    now = docs[0].limit(0)
    for _, stage in C.STAGES:
        now = materialize(stage(spark, now, SF))
        assert now.isEmpty()
