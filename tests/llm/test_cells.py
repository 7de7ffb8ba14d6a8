"""Groups of rows that share a line are not paired where sizes and places leave no similarity."""

import itertools

from pyspark.sql import functions as F

from tidemark.llm import similar


def _members(spark, rows):
    return spark.createDataFrame(rows, "key long, m struct<rep:long,size:int,pos:int>, root long")


def test_a_shared_line_joins_nothing(spark):
    line = "one line of eleven words that very many short documents share"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + " w"), F.col("id")).alias("text"))
    counts = similar.similar_groups(docs).groupBy("component_id").count().where("count > 1")
    assert counts.isEmpty()
    signed = spark.range(4000).select(F.lit(1).cast("long").alias("key"), F.struct("id", F.lit(8).alias("size"), F.lit(1).alias("pos")).alias("m"), F.col("id").alias("root"))
    named = signed.select("key", F.struct(F.col("m.id").alias("rep"), "m.size", "m.pos").alias("m"), "root", F.lit(0).cast("long").alias("main"))
    assert similar._partners(named, 0.8).isEmpty()


def test_cells_find_every_possible_pair(spark):
    sizes = [(i, 3 + i % 9, i % 3) for i in range(60)]
    rows = [(key, (100 * key + i, size, pos), 100 * key + i if i % 4 else 100 * key) for key in (1, 2) for i, size, pos in sizes]
    got = {tuple(r) for r in similar.across_pairs(_members(spark, rows), 0.8).collect()}
    want = set()
    for key in (1, 2):
        own = [(m, root) for k, m, root in rows if k == key]
        for (x, rx), (y, ry) in itertools.permutations(own, 2):
            could = min(x[1] - x[2], y[1] - y[2]) >= 0.8 / 1.8 * (x[1] + y[1]) - 1e-6
            if rx != ry and rx != 100 * key and could and (ry == 100 * key or x[0] < y[0]):
                want.add((x[0], y[0]))
    assert got == want


def test_empty(spark):
    assert similar.across_pairs(_members(spark, []), 0.8).isEmpty()
