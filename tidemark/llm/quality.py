"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Words and single punctuation bytes, in lower case, are the units; unigrams and
bigrams of units are hashed to 2 ** 18 weights. A unit that stands twice in a row,
or again after one other, is a bigram or gapped bigram of its own kind, the same for
all units, as junk repeats units that no other document has. A document's vector holds its
n-gram counts over the root of their number; its score is the logistic of one sparse dot
product. Training runs the per-coordinate FTRL-proximal update over the bounded
labelled sample, in an order fixed by content, so reruns agree.

Defined results: null and empty texts get the score of the bias alone; a very long text is scored whole, its
counts being divided by the root of their number; without
labelled rows every score is 0.5; documents need no label; repeated rows and rows with one doc_id are scored each, by
their own text, and equal texts tie; an empty table gives no rows; further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.labelled import training_rows
from tidemark.llm.language_id import held_out

BITS = 18
#: Indices of a unit that stands twice in a row, and of one that stands again after one other.
TWICE, AFTER_ONE = 1, 2
#: Labelled documents to learn from, at most about this many.
SAMPLE = 12_000

_CLASS = np.full(256, 1, np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalnum()]] = 2
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of words and single punctuation bytes."""
    n = len(data)
    kind = np.append(_CLASS[data], np.uint8(0))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = kind == 1
    begins = kind == 2
    begins[0] |= word[0]
    begins[1:] |= word[1:] & (~word[:-1] | edge[1:])
    stops = (kind[:-1] == 2) | word[:-1] & (~word[1:] | edge[1:])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight indices of the unigrams, bigrams and repeats that start at each unit (-1: none); bounds of the rows."""
    low = K.LOWER[data]
    starts, ends, first = units(low, offsets)
    h = K.span_hash(K.prefix(low), starts, ends)
    top = np.uint64(64 - BITS)
    two = K.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) >> top if len(h) else np.empty(0, np.uint64)
    pair = np.append(two, np.uint64(0)).astype(np.int64)
    last = first[1:][np.diff(first) > 0] - 1
    pair[:-1][h[1:] == h[:-1]] = TWICE
    pair[last] = -1  # no bigram across rows
    again = np.full(len(h), -1, np.int64)
    again[:-2][h[2:] == h[:-2]] = AFTER_ONE
    again[last] = again[np.maximum(last - 1, 0)] = -1
    return (h >> top).astype(np.int64), pair[: len(h)], again, first


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in K.chunks(batch):
            one, two, gap, first = features(data, offsets)
            index, value = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                all_three = np.concatenate((one[a:b], two[a:b], gap[a:b]))
                where, count = np.unique(all_three[all_three >= 0], return_counts=True)
                index.append(where.astype(np.int32).tobytes())
                value.append((count / np.sqrt(max(2 * (b - a) - 1, 1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["label", "index", "value"])


def ftrl(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, passes: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias after some passes of FTRL-proximal over sparse examples."""
    z, n, bias, seen = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(passes):
        for i, x, y in zip(index, value, label, strict=True):
            w = weights(i)
            error = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - y
            g = error * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
            seen += error * error
            bias -= 0.1 * error / np.sqrt(seen)
    return weights(slice(None)).astype(np.float32), bias


def _train(table: pa.Table) -> pa.Table:
    rows = list(zip(table.column("index").to_pylist(), table.column("value").to_pylist(), table.column("label").to_pylist(), strict=True))
    rows.sort(key=lambda r: (hash_bytes(r[0]), r[2]))
    w, bias = ftrl([np.frombuffer(r[0], np.int32) for r in rows], [np.frombuffer(r[1], np.float32) for r in rows], np.array([float(r[2] > 0) for r in rows]))
    return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "bias": [float(bias)]})


def hash_bytes(b: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(b, digest_size=8).digest()


def _score_rows(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        table = np.append(w, np.float32(0))  # index -1: no bigram
        for batch in batches:
            found = []
            for _, _, data, offsets in K.chunks(batch):
                one, two, gap, first = features(data, offsets)
                part = np.concatenate(([0.0], np.cumsum(table[one].astype(np.float64) + table[two] + table[gap])))
                n = np.maximum(2 * np.diff(first) - 1, 1)
                found.append(1 / (1 + np.exp(-np.clip((part[first[1:]] - part[first[:-1]]) / np.sqrt(n) + bias, -35, 35))))
            score = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns where crc32(doc_id as text) mod 3 is not 1."""
    rows = training_rows(docs, labels, "quality", 3, 1, SAMPLE).mapInArrow(_vector_rows, "label int, index binary, value binary")
    got = rows.groupBy(F.lit("all").alias("all")).applyInArrow(_train, "weights binary, bias double").collect()
    model = (np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(3, 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_score_rows(shared), "doc_id long, held_out boolean, score double, predicted int")
