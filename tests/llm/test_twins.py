"""Top-k search where query ids repeat."""

from __future__ import annotations

from collections import Counter

import numpy as np

from tidemark.llm.topk_search import top_k


def test_twins_have_their_own_ranks(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 230, [float(v) for v in rng.normal(0, 1, 8)]) for i in range(460)] + [(100, [0.5] * 8)] * 2
    whole = [np.floor(np.array(v) * 1024).astype(np.int64) for _, v in rows]
    want = Counter()
    for a, (q, _) in enumerate(rows):
        if q % 100 == 0:
            best = sorted(((-int(whole[a] @ whole[b]), rows[b][0]) for b in range(len(rows)) if b != a))[:10]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    got = Counter(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())
    assert got == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.integers(-30_000, 30_000, 12)]) for i in range(300)]
    whole = [np.array(v, dtype=np.int64) * 1024 for _, v in rows]
    want = {(q, n + 1, i, -s) for q in range(0, 300, 100) for n, (s, i) in enumerate(sorted((-int(whole[q] @ whole[b]), b) for b in range(300) if b != q)[:10])}
    assert {tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == want
