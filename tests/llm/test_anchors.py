"""Marks of windows whose least gram has rank 0."""

from __future__ import annotations

import numpy as np

from tidemark.llm import kernels as K


def test_every_window_marks_a_place_of_rank_zero():
    order = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint32)
    at = set(K.anchors(order, 7, np.array([0, 120, 204]), 5).tolist())
    for a, b in ((0, 120), (120, 204)):
        for i in range(a, b - 10):
            assert at & set(range(i, i + 7))
    assert K.anchors(np.array([5, 0, 7], np.uint32), 3, np.array([0, 7]), 5).tolist() == [1]
