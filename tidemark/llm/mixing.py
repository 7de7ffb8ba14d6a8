"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Of all document rates between 0 and ``cap``, those of least Kullback-Leibler divergence
from one copy each that meet every source's word target are exponential tilts, the
lesser of ``cap`` and exp(lambda * size). One lambda for each source solves a convex
dual; Newton's iterations, held inside a bracket that halves wherever a step
leaves it, find them all at once. Documents of one source and size have one rate,
so the iterations run over counts of documents by source and size, of which a
source has no more than it has different sizes. Rates then become whole copies for
each size, rounded along the sizes so that errors cancel, and the words
still missing or in excess are settled by a few single moves, each of the size nearest to them.

Defined results: a null or empty text has size 0, takes no words and no part; a very long text is a size like any
other; a null source is a source of its own and the last; repeated rows count each; documents of one source and size
tie, and a hash of doc_id and text tells which of them take one copy more; an empty table
gives no rows; further columns of the input are ignored, or in ``mixed`` kept. A tilt that doesn't settle raises.
The single moves end when none brings a source nearer to its target, or after a fixed number: what is then
left is less than the largest size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.rows import others, row_hash
from tidemark.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Sub-groups of documents with one source and size, so that no task orders them all.
SALTS = 64
STEPS, ROUNDS = 6, 20


def sizes(docs: DataFrame, *carry: Column) -> DataFrame:
    """(doc_id, key, size, place, salt, carried columns): the words of each text; key keeps the sources' order, null last."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), size.alias("size"), row_hash().alias("place"), F.pmod(row_hash(), F.lit(SALTS)).cast("int").alias("salt"), *carry)


def targets(counted: DataFrame, cap: float = 3.0) -> DataFrame:
    """(key, source_size, target): shares by weight, none above ``cap`` times its source; one row for each source."""
    by_key = counted.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    one = W.partitionBy(F.lit(0))  # the sources alone: a row for each
    weighed = by_key.withColumn("weight", ((F.row_number().over(one.orderBy("key")) - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    # Sources reach their cap in the order of cap by weight; the level is set where the first one doesn't.
    by_ratio = one.orderBy(F.col("most") / F.col("weight"), "key")
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    all_words = F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = weighed.withColumn("level", (all_words - before) / above)
    held = level.withColumn("level", F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("key"), F.col("level")))).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"])
    return held.select("key", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def _whole(order: Column) -> W:
    return W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def tilt(cells: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``rate`` to (key, size, n, source_size, target): the tilted rate of documents of that source and size."""
    w, top = _whole(F.col("size")), F.log(F.lit(cap))
    x = F.col("size") / F.col("unit")
    ratio = F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-300)))
    now = cells.withColumn("unit", F.col("source_size") / F.sum("n").over(w)).withColumn("least", F.min(x).over(w))
    now = now.select("key", "size", "n", "source_size", "target", "unit", F.lit(0.0).alias("lam"), F.lit(False).alias("done"), F.when(ratio < 0, ratio / F.col("least")).otherwise(0.0).alias("lo"), F.when(ratio > 0, top / F.col("least")).otherwise(0.0).alias("hi"))
    words = F.col("n") * F.col("size")
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            power = F.col("lam") * x
            rate = F.when(power >= top, F.lit(cap)).otherwise(F.exp(F.least(power, top)))
            now = now.withColumns({"got": F.sum(words * rate).over(w), "slope": F.sum(F.when(power < top, words * x * rate).otherwise(0.0)).over(w)})
            over = F.col("got") > F.col("target")
            now = now.withColumns({"done": F.abs(F.col("got") - F.col("target")) <= F.col("target") * 1e-9 + 1e-6, "lo": F.when(over, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(over, F.col("lam")).otherwise(F.col("hi"))})
            step = F.when(F.col("slope") > 0, F.col("lam") - (F.col("got") - F.col("target")) / F.greatest("slope", F.lit(1e-300)))
            inside = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
            now = now.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("got", "slope")
        now = materialize(now)
        if now.where(~F.col("done") & (F.col("hi") - F.col("lo") > F.greatest(F.lit(1.0), F.abs("lam")) * 1e-14)).isEmpty():
            break
    else:
        raise RuntimeError(f"the tilt did not settle in {ROUNDS * STEPS} steps")
    power = F.col("lam") * x
    return now.select("key", "size", "n", "source_size", "target", F.when(power >= top, F.lit(cap)).otherwise(F.exp(F.least(power, top))).alias("rate"))


def copies(cells: DataFrame, cap: int = 3) -> DataFrame:
    """Add ``m`` to the rated cells: whole copies that all documents of the cell take together."""
    falling = W.partitionBy("key").orderBy(F.col("size").desc())
    # Errors of rounding along falling sizes telescope: together they stay below the largest size.
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(falling.rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    now = cells.withColumn("upto", upto).withColumn("m", F.col("upto") - F.coalesce(F.lag("upto").over(falling), F.lit(0))).withColumn("m", F.least(F.greatest(F.col("m"), F.lit(0)), F.col("n") * cap)).drop("upto")
    w = _whole(F.col("size"))
    for _ in range(2):
        for _ in range(STEPS):
            now = now.withColumn("left", F.round(F.col("target") - F.sum(F.col("m") * F.col("size")).over(w)).cast("long"))
            room = F.when(F.col("left") > 0, F.col("n") * cap - F.col("m")).otherwise(F.col("m"))
            many = F.greatest(F.least(room, F.floor(F.abs("left") / F.max("size").over(w))), F.lit(1))
            cost = F.abs(F.abs("left") - many * F.col("size"))
            fits = (room > 0) & (cost < F.abs("left"))
            now = now.withColumns({"many": many, "pick": F.min(F.when(fits, F.struct(cost.alias("cost"), F.col("size")))).over(w)["size"]})
            now = now.withColumn("m", F.when(F.col("size") == F.col("pick"), F.col("m") + F.signum("left").cast("long") * F.col("many")).otherwise(F.col("m")))
        now = materialize(now.drop("left", "pick", "many"))
    return now


def _placed(docs: DataFrame, cap: int, order: Column, *carry: Column) -> DataFrame:
    """Every row of ``sizes`` with its own ``copies``; rows equal in doc_id and text go by ``order``."""
    rows = sizes(docs, order.alias("order"), *carry)
    rows = rows if carry else materialize(rows)  # numbers alone: the texts are read once
    fine = materialize(rows.groupBy("key", "size", "salt").agg(F.count("*").alias("n")))
    goals = materialize(targets(fine, cap))
    cells = fine.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")).join(goals, "key")
    planned = copies(tilt(cells, cap), cap)
    # A cell's copies: as many for each document as go round; the rest to the first by a hash, salt by salt.
    by_salt = W.partitionBy("key", "size").orderBy("salt")
    shares = fine.withColumnRenamed("n", "own").join(planned.select("key", "size", "n", "m"), ["key", "size"]).withColumn("before", F.coalesce(F.sum("own").over(by_salt.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    shares = shares.select("key", "size", "salt", F.floor(F.col("m") / F.col("n")).alias("each"), F.greatest(F.col("m") % F.col("n") - F.col("before"), F.lit(0)).alias("extra"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy(F.xxhash64(F.lit(7), "place"), "place", "order")))
    placed = ranked.join(shares, ["key", "size", "salt"], "left").join(goals, "key")
    n = F.coalesce(F.col("each") + (F.col("rank") <= F.col("extra")).cast("long"), F.lit(0))
    return placed.withColumn("copies", n)


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row."""
    return _placed(docs, cap, F.lit(0)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes each, whatever its doc_id."""
    taken = _placed(docs, cap, others(docs), F.struct("*").alias("row")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time")).select("row.*")
