"""Keys of rows that hold where a doc_id is null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_ID = (1 << 63) - 1


def row_key() -> list[Column]:
    """(id, th): equal for rows with the same doc_id and text alone, but for a 64-bit hash; a null id sorts last."""
    no_id = F.col("doc_id").isNull()
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.col("text").cast("string"), no_id).alias("th")]


def row_hash() -> Column:
    """``row_key`` in one 64-bit hash."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("doc_id").isNull())


def others(docs: DataFrame) -> Column:
    """What tells rows with one key apart: the further columns as text."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("")
