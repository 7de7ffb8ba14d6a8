"""Shared by the two operators that remove repeated spans: row keys, lists per row, unions of spans."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, doc_id, text): a row is known by its id and a 64-bit hash of its text; a null id sorts first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "doc_id", "text")


def with_lists(docs: DataFrame, rows: DataFrame, how: str, *cols: str) -> DataFrame:
    """Join to each row of ``keyed`` the sorted structs of its own rows in ``rows``, as column ``found``.

    A list is bounded by the length of its text.
    """
    lists = rows.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("found"))
    return docs.join(lists, ["id", "th"], how)


def list_of(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of column ``found``; a null list is empty."""
    col = batch.column(batch.schema.get_field_index("found"))
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def covered(size: int, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of ``size`` units lie in any of the spans."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, stop, -1)
    return np.cumsum(step)[:size] > 0


def digests(kept: bytes, bounds: np.ndarray) -> list[str]:
    return [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
