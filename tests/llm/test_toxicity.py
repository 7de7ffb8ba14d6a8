"""The field's messages and gradient against enumeration and differences; scores over other layouts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

import tidemark.llm.toxicity as T
from tidemark.llm import queries as Q


def log_likelihood(u, y, move):
    def weight(tags):
        before, total = 0, 0.0
        for x, t in zip(u, tags, strict=True):
            total += x * t + move[before] * t
            before = t
        return total

    return weight(y) - np.log(sum(np.exp(weight(t)) for t in product((0, 1), repeat=len(u))))


@pytest.mark.parametrize("run", [1, 2, 3, 64])
def test_gradient_matches_differences(monkeypatch, run):
    monkeypatch.setattr(T, "RUN", run)
    rng = np.random.default_rng(3)
    size = np.array([5, 0, 1, 7])
    u, y, move = rng.normal(0, 1, 13), rng.integers(0, 2, 13).astype(float), np.array([-0.7, 1.3])
    start = np.cumsum(size) - size
    g, g_move = T.gradient(u, y, start, size, move)

    def whole(u, move):
        return -sum(log_likelihood(u[a : a + n], y[a : a + n].astype(int), move) for a, n in zip(start, size, strict=True))

    for i in range(13):
        step = np.eye(13)[i] * 1e-5
        assert g[i] == pytest.approx((whole(u + step, move) - whole(u - step, move)) / 2e-5, abs=1e-6)
    for i in range(2):
        step = np.eye(2)[i] * 1e-5
        assert g_move[i] == pytest.approx((whole(u, move + step) - whole(u, move - step)) / 2e-5, abs=1e-6)


def test_blocks_hand_over_their_messages(monkeypatch):
    rng = np.random.default_rng(4)
    size = np.array([700, 64, 65, 3])
    u, move = rng.normal(-1, 2, size.sum()), T._move(np.array([-2.0, 2.0]))
    start = np.cumsum(size) - size
    cut = T.marginals(u, start, size, move)
    monkeypatch.setattr(T, "RUN", 1024)
    assert np.allclose(cut, T.marginals(u, start, size, move))


def test_scores_do_not_depend_on_the_layout(spark):
    docs, labels = (Q.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(2))  # repeated rows
    found = [sorted((r.doc_id, r.score, r.predicted) for r in T.toxicity(docs.repartition(n), labels).collect()) for n in (1, 7, 31)]
    assert found[0] == found[1] == found[2] and len({s for _, s, _ in found[0]}) > 2
