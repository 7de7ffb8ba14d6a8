"""Shard files as the query writes them: an independent slot table, checksums, repeated and empty rows."""

from __future__ import annotations

import hashlib
from collections import Counter

from tidemark.llm.token_shards import feistel, read_sequences, token_shards

SCHEMA = "doc_id long, text string, record string, shard string"


def test_files_hold_the_rows(spark):
    rows = [(i % 40, f"text {i % 55} " * (1 + i % 90), "x", "y") for i in range(300)] + [(None, None, "x", "y"), (3, "", "x", "y"), (3, "", "x", "z")]
    made = [token_shards(spark.createDataFrame(rows, SCHEMA).repartition(n), length=16, per_shard=50) for n in (1, 6)]
    got = made[0].collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert Counter((r.slot, r.doc_id, r.seq, r.record) for r in got) == Counter((r.slot, r.doc_id, r.seq, r.record) for r in made[1].collect())
    for path, sha in {(r.path, r.sha256) for r in got}:
        with open(path, "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == sha
    for r in got:
        (ids,) = read_sequences(r.path, r.slot % 50, 1, 16)
        assert r.shard == r.slot // 50 and len(ids) == r.n_tokens and r.record[4 : 4 + 2 * len(ids)] == ids.tobytes()
    # The dense number before the permutation keeps a document's sequences together and in their order.
    number = {int(s): n for n, s in enumerate(feistel(__import__("numpy").arange(len(got)), len(got), 20_240_601))}
    by = sorted((number[r.slot], r.doc_id, r.seq) for r in got)
    assert all(b[2] == 0 or (b[1] == a[1] and b[2] == a[2] + 1) for a, b in zip(by, by[1:], strict=False))
    assert token_shards(spark.createDataFrame([], SCHEMA)).count() == 0
