"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints at
most ``distance`` bits apart, one segment differs in at most one bit. Every
segment is indexed once for each of its bits with that bit left out; such a pair
then shares an index key, whichever bit differs. An equality grouping on the keys
gives the candidates and the whole fingerprints verify them. Copies collapse to
one fingerprint first, and a key's group returns links that span its connected
parts, never all its pairs.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, which links like any other; fewer words than a shingle make one
shingle of them all; a very long text is one set of shingles like any other; repeated rows stay as they are and
take one component; a null doc_id keeps its row but is never a component's name (a component of null ids alone
has none); ties don't arise; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.components import components
from tidemark.llm.skew import join_counted
from tidemark.llm.store import materialize

_BYTES = np.uint64(0x0101010101010101)
#: Groups up to this size are compared in blocks; larger ones are cut by exact pieces first.
BLOCK = 2048


def fold_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint for each row's hashes: bits set in over half of them; zero for none."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), np.uint64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    # Eight counters of a byte each in one integer; pieces of 255 hashes can't overflow them.
    pieces = (sizes[rows] + 254) // 255
    nth = K.take_ranges(np.zeros(len(rows), np.int64), pieces)
    cuts = np.repeat(first[rows], pieces) + 255 * nth
    of_row = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    counts = np.empty((len(rows), 64), np.int64)
    for bit in range(8):
        part = np.add.reduceat((hashes >> np.uint64(bit)) & _BYTES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:, bit::8] = np.add.reduceat(part.astype(np.int64), of_row, axis=0)
    bits = (2 * counts > sizes[rows][:, None]).astype(np.uint8)
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): XXH64 of each row's word shingles, repeats included; those of row i are first[i] to first[i + 1]."""
    digest = xxhash.xxh64_intdigest
    starts, ends, first = K.words(data, offsets)
    size = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(size)))
    flat = K.LOWER[np.append(data, np.uint8(32))[K.take_ranges(starts, size)]]
    flat[at[1:] - 1] = 32  # one space after each word
    n = np.diff(first)
    of = np.maximum(n - shingle + 1, np.minimum(n, 1))
    begin = K.take_ranges(first[:-1], of)
    last = np.minimum(begin + shingle, np.repeat(first[1:], of))
    buf = flat.tobytes()
    got = [digest(buf[a:b], 42) for a, b in zip(at[begin].tolist(), (at[last] - 1).tolist(), strict=True)]
    return np.array(got, np.uint64), np.concatenate(([0], np.cumsum(of)))


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fold_bits(*shingle_hashes(data, offsets, shingle)) for _, _, data, offsets in K.chunks(batch)]
            prints = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text's word shingles as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_rows(shingle), "doc_id long, fp long")


def _linked(x: np.ndarray, distance: int) -> np.ndarray:
    """For each of a group's fingerprints the index of the least one that it is connected with."""
    n = len(x)
    label = np.arange(n)
    if n <= BLOCK:
        near = [np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) <= distance for i in range(0, n, 256)]
        while True:
            now = np.concatenate([np.where(m, label[None, :], n).min(axis=1) for m in near])
            now = now[now]
            if (now == label).all():
                return label
            label = now
    # Of distance + 1 exact pieces one is equal: cut, link within equal pieces, and merge the labels.
    width = 64 // (distance + 1)
    while True:
        before = label.copy()
        for piece in range(distance + 1):
            low = np.uint64(piece * width)
            bits = x >> low if piece == distance else (x >> low) & np.uint64((1 << width) - 1)
            order = np.argsort(bits, kind="stable")
            cuts = np.flatnonzero(np.diff(bits[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    label = _merge(label, part, x, distance)
        if (label == before).all():
            return label


def _merge(label: np.ndarray, part: np.ndarray, x: np.ndarray, distance: int) -> np.ndarray:
    while True:
        own = label[part]
        now = np.concatenate([np.where(np.bitwise_count(x[part[i : i + 256], None] ^ x[None, part]) <= distance, own[None, :], len(x)).min(axis=1) for i in range(0, len(part), 256)])
        if (now == own).all():
            return label
        lower = np.arange(len(label))
        np.minimum.at(lower, own, now)
        while (lower != lower[lower]).any():
            lower = lower[lower]
        label = lower[label]


def _link_rows(distance: int):
    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        cuts = np.flatnonzero(np.diff(key)) + 1
        begin, stop = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        size = stop - begin
        x = fp.view(np.uint64)
        two = begin[size == 2]
        near = np.bitwise_count(x[two] ^ x[two + 1]) <= distance
        a.append(fp[two[near]])
        b.append(fp[two[near] + 1])
        for i, j in zip(begin[size > 2].tolist(), stop[size > 2].tolist(), strict=True):
            label = _linked(x[i:j], distance)
            apart = np.flatnonzero(label != np.arange(j - i))
            a.append(fp[i:j][apart])
            b.append(fp[i:j][label[apart]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(v) for v in links(key, fp)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and key[-1] == held[-1][0][-1]:
                held.append((key, fp))  # one group goes on through the whole batch
                continue
            done = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            held.append((key[:done], fp[:done]))
            yield close()
            held = [(key[done:], fp[done:])]
        if held:
            yield close()

    return run


def fingerprint_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that span the connected parts of distinct ``fp`` values at most ``distance`` bits apart."""
    segments = distance // 2 + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    # Bit i's key: its segment without that bit, with i on top where the segment can't reach.
    masks = [[((1 << edges[s + 1]) - (1 << edges[s])) & ~(1 << i), edges[s], i] for s in range(segments) for i in range(edges[s], edges[s + 1])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    if segments == 1:
        raise ValueError("distance must be 2 or more")
    wide = [F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(signed(m))), low).bitwiseOR(F.lit(signed(i << 57))) for m, low, i in masks]
    keyed = prints.select("fp", F.explode(F.array(*wide)).alias("key")).select("key", "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_rows(distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints connect share the least doc_id reachable."""
    prints = materialize(fingerprints(docs, shingle))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    found = components(fingerprint_links(reps.select("fp"), distance))
    joined = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(joined.join(least, "root").select("fp", "component_id", "n"))
    return join_counted(prints, named, "fp", "doc_id").select("doc_id", "fp", "component_id")


def op10_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
