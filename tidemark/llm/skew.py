"""Equality joins with counted keys that hold however many rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this fraction (one in ...) of the counted rows is hot; there can be no more such keys.
HOT_KEYS = 4096


def join_counted(rows: DataFrame, counts: DataFrame, key: str, *place: str) -> DataFrame:
    """Join ``rows`` with ``counts`` (a written table: one row for each ``key``, its rows ``n``, further columns).

    A hot key is dealt over as many salts as it has times one in ``HOT_KEYS`` of all rows,
    by a hash of ``place``, and its one row of ``counts`` is repeated for each. No more than
    ``HOT_KEYS`` keys can be hot, so their list is broadcast; all salts together are twice that
    at most. A null key joins nothing; empty tables give no rows; equal rows are all kept.
    """
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    salts = F.ceil(F.col("n") * HOT_KEYS / max(total, 1)).cast("int")
    hot = counts.where(F.col("n") * HOT_KEYS > total).select(key, salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*place), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    repeats = F.when(F.col("n") * HOT_KEYS > total, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return salted.join(counts.withColumn("salt", F.explode(repeats)).drop("n"), [key, "salt"]).drop("salt")


def join_salted(rows: DataFrame, others: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """Join ``rows`` (a written table) with ``others``, which may also have many rows for each of the ``keys``.

    Keys with more than one in ``HOT_KEYS`` of ``rows`` are dealt over salts by a hash of ``place``, and their ``others``
    are repeated for each salt. A null key joins nothing; empty tables give no rows; equal rows are all kept.
    """
    total = rows.count()
    counts = rows.groupBy(*keys).agg(F.count("*").alias("own")).where(F.col("own") * HOT_KEYS > total)
    hot = counts.select(*keys, F.ceil(F.col("own") * HOT_KEYS / max(total, 1)).cast("int").alias("salts"))
    deal = F.coalesce(F.pmod(F.xxhash64(*place), F.col("salts")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", deal).drop("salts")
    right = others.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"]).drop("salt")


#: Most keys that ``matching`` broadcasts: 16 MB of numbers.
FEW = 1 << 21


def matching(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` with (or with "left_anti" without) their ``key`` in ``keys``, a written table of distinct numbers.

    The keys are counted; up to ``FEW`` of them are broadcast, so that the rows aren't shuffled, and more are joined
    by a shuffle. A null key matches nothing; empty keys match nothing; repeated rows are all kept.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, key, how)
