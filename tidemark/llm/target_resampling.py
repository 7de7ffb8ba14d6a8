"""Importance resampling of documents towards a target set, by hashed word features.

Identical texts are collapsed by grouping the full text. Features are hashed once for each
distinct text and written as bucket numbers; their counts are multiplied by the text's
multiplicity. A bucket's gain compares the target's share of it with the documents' own; a
text's weight is the mean gain of its features. Weights go back to the documents by the
text's SHA-256, hot texts dealt over salts; each document then adds Gumbel noise of its own,
so that the highest scores are a draw without replacement.

Ranks need no sorting of all documents in one place: scores are whole numbers, so documents
are counted by score (a few tens of thousands of values, whatever the input), the counts are
summed from the highest score on, and only documents of one score are ordered among each other.

Defined results: a null text counts as an empty one, has no features and weight 0; a very long text is
one text with many features; equal rows score alike and each takes a rank of its own; ties in score
go to the smaller doc_id, null ids last, whose noise is that of an empty string; with repeated doc_ids of one
score the lesser weight, then the lesser hash of the text comes first; an empty table gives no rows; an empty target makes all gains follow from its
zero counts; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.skew import FEW, join_counted
from tidemark.llm.store import discard, materialize

BUCKETS, ORDER, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Steps of the checksum that are taken for all words at once; what is left of longer ones goes one by one.
TOGETHER = 48
#: Scores that are counted together before their counts are summed from the top.
BAND = 256


def _table() -> np.ndarray:
    """The checksum's remainders of all bytes, from its polynomial."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & np.uint32(1), (row >> np.uint32(1)) ^ np.uint32(0xEDB88320), row >> np.uint32(1))
    return row


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, one byte of all of them at a time."""
    table, crc = _table(), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live, length = np.arange(len(starts)), ends - starts
    for step in range(TOGETHER):
        live = live[length[live] > step]
        if not live.size:
            break
        now = crc[live]
        crc[live] = table[(now ^ data[starts[live] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] + TOGETHER : ends[i]].tobytes(), int(out[i]))
    return out


_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, features of each text, words of each text); features of a text lie together."""
    data = K.LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside[:-1] & (~inside[1:] | edge[1:])
    begins[1:] &= ~inside[:-1] | edge[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    words = np.diff(np.searchsorted(starts, offsets))
    if order == 1:
        return crc32_ranges(data, starts, ends) % buckets, words, words
    # Words joined by one space, so that a run of words is a range of bytes.
    length = ends - starts + 1
    joined = np.full(int(length.sum()), 0x20, np.uint8)
    to = np.cumsum(length) - length
    joined[K.take_ranges(to, length - 1)] = data[K.take_ranges(starts, length - 1)]
    row, first = np.repeat(np.arange(len(words)), words), np.cumsum(words) - words
    found, owner = [], []
    for k in range(1, order + 1):
        at = np.flatnonzero(np.arange(len(row)) + k <= first[row] + words[row])
        found.append(crc32_ranges(joined, to[at], to[at + k - 1] + length[at + k - 1] - 1) % buckets)
        owner.append(row[at])
    by_row = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[by_row], np.bincount(np.concatenate(owner), minlength=len(words)), words


def _features(buckets: int, order: int) -> object:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch):
                found, n, words = feature_buckets(data, offsets, buckets, order)
                ends = np.concatenate(([0], np.cumsum(n))) * np.dtype(kind).itemsize
                raw = found.astype(kind).tobytes()
                each = pa.array([raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(n, pa.int64()), each], names=["digest", "n", "n_words", "n_features", "buckets"])

    return run


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.sha2(_text(), 256)).alias("digest")


def text_features(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(digest, n, n_words, n_features, buckets) for each distinct text, written; n rows of ``docs`` have it."""
    texts = docs.select(_text().alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    each = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "n", "text")
    return materialize(each.mapInArrow(_features(buckets, order), "digest binary, n long, n_words long, n_features long, buckets binary"))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences over all rows, texts times their multiplicity; each task adds up its own first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            np.add.at(total, np.frombuffer(b"".join(raw), kind), np.repeat(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], names=["bucket", "n"])

    return features.select("n", "n_features", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from two tables of ``bucket_counts``."""
    size = lambda df: (df.agg(F.sum("n")).collect()[0][0] or 0)
    s_all, t_all = float(size(own) + buckets), float(size(target) + buckets)
    every = own.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    up = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    return both.select("bucket", F.floor(1000.0 * F.log(up("t") * s_all / (up("s") * t_all))).cast("long").alias("gain"))


def text_weights(features: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(digest, n, n_words, n_features, weight), written. Only the table of gains, one number a bucket, is broadcast."""
    found = np.zeros(buckets, np.int64)
    for row in gain.collect():
        found[row["bucket"]] = row["gain"]
    shared = features.sparkSession.sparkContext.broadcast(found)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy()
            upto = np.concatenate(([0], np.cumsum(shared.value[np.frombuffer(b"".join(batch.column(4).to_pylist()), kind)])))
            ends = np.cumsum(n)
            mean = np.where(n > 0, (upto[ends] - upto[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(mean)], names=["digest", "n", "n_words", "n_features", "weight"])

    return materialize(features.mapInArrow(run, "digest binary, n long, n_words long, n_features long, weight long"))


def noise(seed: int = SEED) -> Column:
    """A whole number of thousandths of Gumbel noise that follows from doc_id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw_highest(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to a written table: 1, 2, ... for the ``percent`` of documents of enough words with the highest scores, else null."""
    able = F.col("n_words") >= least_words
    band = F.floor(F.col("score") / BAND)
    counted = materialize(scored.where(able).groupBy("score").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).collect()[0][0] or 0
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = counted.groupBy(band.alias("band")).agg(F.sum("n").alias("n"))
    outer = bands.select("band", above(W.partitionBy(F.lit(0)).orderBy(F.desc("band"))).alias("outer"))  # a few hundred rows
    inner = counted.select("score", band.alias("band"), above(W.partitionBy(band).orderBy(F.desc("score"))).alias("inner"))
    drawn = total * percent // 100
    cut = materialize(inner.join(outer, "band").select("score", (F.col("inner") + F.col("outer")).alias("ahead")).where(F.col("ahead") < drawn))
    near = scored.where(able).join(F.broadcast(cut) if cut.count() <= FEW else cut, "score")
    tied = W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "digest")
    place = F.col("ahead") + F.row_number().over(tied)
    ranked = near.select(*scored.columns, F.when(place <= drawn, place).cast("long").alias("rank"))
    least = cut.agg(F.min("score")).collect()[0][0]
    rest = scored if least is None else scored.where(~able | (F.col("score") < least))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; those with a rank are the sample."""
    features = text_features(docs, buckets, order)
    wanted = text_features(target, buckets, order)
    gain = gains(materialize(bucket_counts(features, buckets)), materialize(bucket_counts(wanted, buckets)), buckets)
    weights = text_weights(features, gain, buckets)
    discard(features)
    discard(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), F.monotonically_increasing_id().alias("at"))
    joined = join_counted(rows, weights, "digest", "at").withColumn("score", F.col("weight") + noise(seed))
    scored = materialize(joined.select("doc_id", "digest", "n_words", "n_features", "weight", "score"))
    return draw_highest(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
