"""The greedy choice of non-overlapping trades, as links to successors that are followed in parallel.

Each candidate has one successor: the first candidate after its exit. Successors are found block by block, so a
series may lie over many tasks. The chain from a series' first candidate is then followed by doubling: links of
1, 2, 4, ... trades, each kept only for candidates that some chain of that stride can reach. Chains from different candidates soon meet, so the
tables shrink from one stride to the next. On the way back every stride doubles the known part of the chain.
Series of few candidates are chosen from in one row each, without any round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut

#: Bar numbers of a block in which successors are looked up together.
BLOCK = 4096
#: Candidates of a series that are chosen from in one row.
SHORT = 4096


def successors(slim: DataFrame, by: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """(by, node, jump): for each entry_idx the first entry_idx above ``free``; no row where there is none."""
    place = lambda c: F.floor(F.col(c) / block).alias("block")
    entries = slim.select(*by, F.col("entry_idx").alias("at"), place("entry_idx"), F.lit(1).alias("entry"))
    asked = slim.select(*by, F.col("free").alias("at"), place("free"), F.lit(0).alias("entry")).distinct()
    both = entries.unionByName(asked)
    # Falling numbers, questions before entries of their number: the least entry so far is the first one above.
    falling = W.partitionBy(*by, "block").orderBy(F.desc("at"), "entry").rowsBetween(W.unboundedPreceding, 0)
    inside = both.withColumn("near", F.min(F.when(F.col("entry") == 1, F.col("at"))).over(falling)).where("entry = 0")
    firsts = both.groupBy(*by, "block").agg(F.min(F.when(F.col("entry") == 1, F.col("at"))).alias("first"))
    later = W.partitionBy(*by).orderBy("block").rowsBetween(1, W.unboundedFollowing)  # a row for each block
    blocks = firsts.select(*by, "block", F.min("first").over(later).alias("far"))
    answered = inside.join(blocks, [*by, "block"]).select(*by, F.col("at").alias("free"), F.coalesce("near", "far").alias("jump")).where("jump is not null")
    return slim.join(answered, [*by, "free"]).select(*by, F.col("entry_idx").alias("node"), "jump")


def chains(slim: DataFrame, by: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """(by, entry_idx, seq): the chain from each series' first candidate, by doubling."""
    roots = cut(slim.groupBy(*by).agg(F.min("entry_idx").alias("node")))
    now, strides = cut(successors(slim, by, block)), []
    while not now.isEmpty():
        strides.append(now)
        second = now.select(*by, F.col("node").alias("jump"), F.col("jump").alias("far"))
        twice = cut(now.join(second, [*by, "jump"]).select(*by, "node", F.col("far").alias("jump")))
        reached = twice.select(*by, F.col("jump").alias("node")).unionByName(roots).distinct()
        now = cut(twice.join(reached, [*by, "node"], "left_semi"))
    known = roots.withColumn("seq", F.lit(1).cast("long"))
    for k in range(len(strides) - 1, -1, -1):
        further = known.join(strides[k], [*by, "node"]).select(*by, F.col("jump").alias("node"), (F.col("seq") + (1 << k)).alias("seq"))
        known = cut(known.unionByName(further))
    return known.withColumnRenamed("node", "entry_idx")


def short_chains(slim: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same for series whose candidates fit into one row each."""
    rows = slim.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("entry_idx", "free"))).alias("all"))
    start = F.struct(F.lit(-1).cast("long").alias("free"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda acc, x: F.when(x["entry_idx"] > acc["free"], F.struct(x["free"].alias("free"), F.array_append(acc["taken"], x["entry_idx"]).alias("taken"))).otherwise(acc)
    taken = rows.select(*by, F.posexplode(F.aggregate("all", start, take)["taken"]).alias("seq", "entry_idx"))
    return taken.select(*by, "entry_idx", (F.col("seq") + 1).cast("long").alias("seq"))


def chosen(slim: DataFrame, by: tuple[str, ...], short: int = SHORT) -> DataFrame:
    """(by, entry_idx, seq) of the greedy sequence: none enters up to the one before's ``free``."""
    slim = slim.select(*by, F.col("entry_idx").cast("long").alias("entry_idx"), F.col("free").cast("long").alias("free"))
    longest = slim.groupBy(*by).count().agg(F.max("count")).collect()[0][0] or 0
    return short_chains(slim, by) if longest <= short else chains(cut(slim), by)
