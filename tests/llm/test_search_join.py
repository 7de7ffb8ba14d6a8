"""Index blocks meet query blocks by a shuffle, never by way of the driver."""

from __future__ import annotations

from tidemark.llm.topk_search import top_k


def test_top_k_sends_no_block_through_the_driver(spark):
    vectors = spark.createDataFrame([(i, [i % 7 / 8, i % 5 / 4]) for i in range(300)], "vec_id long, embedding array<float>")
    found = top_k(vectors, k=2)
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    assert set(rows) == {(q, k) for q in (0, 100, 200) for k in (1, 2)}
    whole = {i: (1024 * (i % 7) // 8, 1024 * (i % 5) // 4) for i in range(300)}
    for q in (0, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:2]
        assert [rows[q, k] for k in (1, 2)] == [(i, -s) for s, i in best]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
