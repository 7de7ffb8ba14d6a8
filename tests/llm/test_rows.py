"""The pipeline's stages decide by row where doc_id is null or repeated."""

from __future__ import annotations

from collections import Counter

import numpy as np

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.mixing import mix, mixed
from tidemark.llm.similar import one_row_of_each

SCHEMA = "doc_id long, text string, source string"


def texts(n, size, seed=1):
    return [" ".join(f"w{x}" for x in row) for row in np.random.default_rng(seed).integers(0, 9000, (n, size))]


def test_near_dedup_by_row(spark):
    a, b, c, d, e = texts(5, 60)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(None, a, "s"), (None, a, "s"), (None, near, "s"), (None, b, "s"), (7, b, "s"), (7, c, "t"), (7, c, "s"), (7, d, "s"), (3, d, "s"), (None, e, "s"), (None, None, "s"), (None, None, "s")]
    kept = one_row_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = [tuple(r) for r in kept if r.text not in (a, near)]
    assert sorted(got, key=str) == sorted([(7, b, "s"), (7, c, "s"), (3, d, "s"), (None, e, "s"), (None, None, "s")], key=str)
    assert len(kept) == 6


def test_decontamination_by_row(spark):
    item, *clean = texts(6, 30)
    rows = [(None, item, "s"), (None, clean[0], "s"), (None, None, "s"), (7, item, "s"), (7, clean[1], "s"), (8, clean[2], "s"), (8, clean[2], "s")]
    left = decontaminate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(tuple(r) for r in left.collect()) == Counter(r for r in rows if r[1] != item)


def test_mixing_by_row(spark):
    rows = [(None if i % 2 else 7, t, "ab"[i % 3 == 0]) for i, t in enumerate(texts(40, 12) + texts(40, 5, 2) + texts(40, 3, 3))]
    rows += [rows[4]] * 3 + [(None, "", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan, got = mix(docs), Counter(tuple(r) for r in mixed(docs).collect())
    taken = Counter((r.doc_id, r.size, r.copies) for r in plan.collect())
    assert sum(n * k for (_, _, n), k in taken.items()) == sum(got.values())
    for size in (3, 5, 12):
        for i in (None, 7):
            assert sum(n * k for (d, s, n), k in taken.items() if (d, s) == (i, size)) == sum(k for (d, t, _), k in got.items() if d == i and len(t.split()) == size)
    assert got == Counter(tuple(r) for r in mixed(docs.repartition(5)).collect())
