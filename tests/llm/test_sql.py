"""op8, op9 and op10 against their SQL, on the smallest tables and on rows of every odd kind."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
PASSAGE = "the passage that several of the documents share, ünïcödé letters and all the rest of it, more than one hundred bytes "


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    texts = [PASSAGE + "one", "two " + PASSAGE, PASSAGE * 3, PASSAGE + "x" * 350 + PASSAGE, "y" * 100, "y" * 99, None, "", PASSAGE, PASSAGE.upper(), "a\tb", " \n", "one " * 40]
    folder = tmp_path_factory.mktemp("small")
    share = "k" * 7 + PASSAGE  # at one offset in rows of one id, and of none
    ties = [(2, share + "one end"), (2, share + "another"), (None, share + "x"), (None, share + "y"), (None, "y" * 120), (9, PASSAGE + "z"), (9, "later " + PASSAGE)]
    spark.createDataFrame(list(enumerate(texts)) + ties, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    return folder, f"{folder}/documents.parquet/*.parquet"


@pytest.mark.parametrize("name", ["op8_suffix_dedup", "op9_substring_dedup", "op10_simhash"])
@pytest.mark.parametrize("which", ["small", "whole"])
def test_matches_sql(spark, small, which, name):
    folder, files = small if which == "small" else (DATA, str(DATA / "documents.parquet"))
    got = queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    want = con.execute(oracle_sql()[name])
    assert [c[0] for c in want.description] == got.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_empty_and_odd_vectors(spark, tmp_path):
    rows = [(0, [0.5, -0.25]), (100, []), (1, []), (2, [1.0, float("nan")]), (3, None), (4, [0.25, 0.5]), (5, [0.1, None]), (100, [-1.0, 2.0]), (6, [-0.5, 0.5]), (200, [float("inf"), 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries()["op2_topk_search"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(oracle_sql()["op2_topk_search"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3 * 5
