"""Importance resampling against a plain loop and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import target_resampling as R
from tidemark.llm.queries import RESAMPLING_SQL

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _grams(text, order):
    w = WORDS.findall(_lower(text))
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)], len(w)


def _brute(docs, target, percent=10, buckets=10_000, order=1, seed=2024, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = Counter(bucket(f) for _, t in docs for f in _grams(t, order)[0])
    aim = Counter(bucket(f) for t in target for f in _grams(t, order)[0])
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, text in docs:
        found, n_words = _grams(text, order)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[2]))
    drawn = {id(r): i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


def _texts(n):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(40)] + ["Ünïts", "数据", "x9", "ABC", "é" * 60, "long" * 30]
    return [" ".join(rng.choice(vocab, rng.integers(0, 60))) for _ in range(n)]


def _frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "'x' as digest", "0 as n")


def _docs():
    texts = _texts(150)
    docs = list(enumerate(texts)) + [(1000 + i, texts[3]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "."), (3, texts[9]), (None, texts[8]), (2003, "tab\tsep,\x00nul " * 40)]
    return docs


@pytest.mark.parametrize("order", [1, 2])
def test_equals_a_loop(spark, order):
    docs, target = _docs(), _texts(30)[10:] + [None]
    got = R.resample(_frame(spark, docs), _frame(spark, [(i, t) for i, t in enumerate(target)]), order=order, percent=25).collect()
    want = _brute(docs, [t for t in target], order=order, percent=25)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_sql(spark):
    docs, target = [d for d in _docs() if d[0] is not None and d[0] != 3], _texts(25)
    got = R.resample(_frame(spark, docs), _frame(spark, list(enumerate(target)))).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?)", [(t,) for t in target])
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(RESAMPLING_SQL).fetchall(), key=str)


def test_empty_tables(spark):
    none = _frame(spark, [])
    assert R.resample(none, none).collect() == []
    some = _frame(spark, [(1, "a b"), (2, None)])
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in R.resample(some, none).collect()) == [(1, 2, None), (2, 0, None)]


def test_checksums():
    raw = [b"", b"a", b"word", b"x" * 47, b"y" * 48, b"z" * 49, bytes(range(256)) * 3]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    got = R.crc32_ranges(data, ends - [len(x) for x in raw], ends)
    assert got.tolist() == [zlib.crc32(x) for x in raw]
