"""The fitted models against plain loops: FTRL, sparse scores, mixture inference, entropy tilts."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import language_id as L
from tidemark.llm import mixing as M
from tidemark.llm import quality as C


class Shared:
    def __init__(self, value):
        self.value = value


def plain_ftrl(examples, alpha, beta, l1, l2, passes):
    """FTRL-proximal, one number at a time."""
    z, n, bias, seen = {}, {}, 0.0, 1.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for x, y in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in x.items()) + bias)))
            for i, v in x.items():
                g = (p - y) * v
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
            seen += (p - y) ** 2
            bias -= 0.1 * (p - y) / math.sqrt(seen)
    return {i: weight(i) for i in z}, bias


def test_ftrl_matches_a_loop():
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(120):
        y = int(rng.integers(2))
        at = rng.choice(40, 8, replace=False)
        examples.append(({int(i): float(np.float32(rng.random() + (y and i < 10))) for i in np.sort(at)}, float(y)))
    settings = {"alpha": 0.3, "beta": 1.0, "l1": 0.05, "l2": 0.5, "passes": 2}
    want, bias = plain_ftrl(examples, **settings)
    index = [np.array(list(x), np.int32) for x, _ in examples]
    value = [np.array(list(x.values()), np.float64) for x, _ in examples]
    got, got_bias = C.ftrl(index, value, np.array([y for _, y in examples]), **settings)
    assert got_bias == pytest.approx(bias, abs=1e-9)
    assert any(want.values())
    assert {i: got[i] for i in want} == pytest.approx(want, abs=1e-6)
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values())


def test_scores_are_dot_products_of_the_vectors():
    texts = ["One two two, one!", "", None, "x", "a b a b a", "ünï ünï " * 500]
    model = (np.random.default_rng(5).normal(size=1 << C.BITS).astype(np.float32), 0.25)
    label = pa.array([0] * len(texts), pa.int32())
    (vectors,) = C._vector_rows([pa.RecordBatch.from_arrays([pa.array(texts), label], names=["text", "label"])])
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.string())], names=["doc_id", "held_out", "text"])
    (scored,) = C._score_rows(Shared(model))([rows])
    for index, value, score in zip(vectors.column("index").to_pylist(), vectors.column("value").to_pylist(), scored.column("score").to_pylist(), strict=True):
        dot = float(model[0][np.frombuffer(index, np.int32)].astype(float) @ np.frombuffer(value, np.float32).astype(float))
        assert score == pytest.approx(1 / (1 + math.exp(-(dot + model[1]))), rel=1e-4, abs=1e-6)


def plain_em(like, share, steps):
    for _ in range(steps):
        new = [0.0] * len(share)
        for word in like:
            part = [s * v for s, v in zip(share, word, strict=True)]
            for k, p in enumerate(part):
                new[k] += p / sum(part) / len(like)
        share = new
    return share, sum(math.log(sum(s * v for s, v in zip(share, word, strict=True))) for word in like)


def plain_infer(ll):
    """One document's shares and chosen languages: add the next likeliest while the penalised likelihood grows."""
    count = len(ll[0])
    like = [[math.exp(v - max(word)) for v in word] for word in ll]
    share, _ = plain_em(like, [1 / count] * count, 6)
    single = [sum(word[k] - max(word) for word in ll) for k in range(count)]
    lead = max(range(count), key=lambda k: single[k])
    order = [lead, *sorted((k for k in range(count) if k != lead), key=lambda k: -share[k])]
    chosen, best = [lead], single[lead]
    if max((share[k] for k in order[1:]), default=0) <= 0.005:
        return share, chosen
    for size in range(2, count + 1):
        tried = order[:size]
        part, value = plain_em(like, [1 / size if k in tried else 0.0 for k in range(count)], 12)
        if value - best <= L.PENALTY * math.log(len(ll) + 1):
            break
        chosen, share, best = tried, part, value
    return share, chosen


def test_mixture_inference_matches_a_loop():
    rng = np.random.default_rng(11)
    docs = []
    for n, mixed in ((1, 1), (3, 1), (40, 1), (60, 2), (90, 3), (200, 2), (5, 4)):
        own = rng.integers(0, mixed, n)
        ll = rng.normal(-20, 1, (n, 4))
        ll[np.arange(n), own] += 9
        docs.append(ll.astype(np.float32))
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    share, chosen = L.infer(np.concatenate(docs), first)
    for i, d in enumerate(docs):
        want, those = plain_infer(d.astype(float).tolist())
        assert set(np.flatnonzero(chosen[i]).tolist()) == set(those)
        assert share[i].tolist() == pytest.approx(want, abs=1e-3)
    assert {int(c) for c in chosen.sum(axis=1)} >= {1, 2, 3}


def test_tilts_match_bisection(spark):
    """Each source's one multiplier, found by plain halving, gives the rates that the Newton rounds give."""
    sources = {"0a": ([(3, 40), (10, 9), (200, 2)], 0.4), "0b": ([(1, 5), (7, 30), (90, 4)], 1.7), "0c": ([(12, 6)], 2.0), "1": ([(2, 3), (5, 8)], 1.0)}
    rows = []
    for key, (cells, ratio) in sources.items():
        words = sum(size * n for size, n in cells)
        rows += [(key, size, n, words, words * ratio) for size, n in cells]
    got = {(r.key, r.size): r.rate for r in M.tilt(spark.createDataFrame(rows, "key string, size long, n long, source_size long, target double")).select("key", "size", "rate").collect()}
    for key, (cells, ratio) in sources.items():
        goal = sum(size * n for size, n in cells) * ratio
        low, high = -50.0, 50.0
        for _ in range(300):
            lam = (low + high) / 2
            taken = sum(size * n * min(3.0, math.exp(min(lam * size, 50))) for size, n in cells)
            low, high = (low, lam) if taken > goal else (lam, high)
        for size, _ in cells:
            assert got[key, size] == pytest.approx(min(3.0, math.exp(min(lam * size, 50))), rel=1e-6)
