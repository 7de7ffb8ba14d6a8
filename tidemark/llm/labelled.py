"""Labelled rows to learn from, up to a documented bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language_id import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(text, label) of rows that are not held out; about ``most`` of them, taken by a hash of doc_id.

    A document with several labels takes the largest; a null label, text or doc_id teaches nothing.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(modulus, remainder)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where("doc_id is not null")
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return text.join(known, "doc_id").select("text", "label")
