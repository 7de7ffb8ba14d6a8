"""Benchmark decontamination by spaced seeds.

Fixed masks look at some of the words in a short span and ignore the rest, so a test
item and a document still share a seed where words were substituted. Seeds of
both sides meet in an equality join; the words around each hit verify that a
window of the item (13 words, or the whole of a shorter item) agrees with the document
in at least 80 % of its places, word against word on one diagonal. The masks
are chosen so that every such window holds a seed: no overlap of this kind is lost.

A Bloom filter of the item seeds, sized by their number up to 8 MB, spares the shuffle almost all seeds of
the documents; it only ever lets too many through, which the join then drops. Seeds that very many
documents hold are dealt over salts.

Words are runs of ASCII letters, digits and all other non-ASCII bytes, in lower case.
Defined results: only documents with an overlap are returned; null and empty texts
have none, items without words neither; rows with equal doc_id, or with a null one, count as one document,
items likewise; repeated rows give the same result as one; a very long text is searched whole; ties don't
arise, as spans are unions; an item of under six words must agree whole; empty tables give no rows; further
columns of either input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.rows import row_hash
from tidemark.llm.skew import join_salted, matching
from tidemark.llm.store import materialize

WINDOW, SIDE = 13, 13
#: The filter's size as a power of two: at least, and at most (2 ** 26 bits are 8 MB).
BLOOM_LEAST, BLOOM_MOST = 20, 26


def allowed(n: int) -> int:
    """Words that may differ in a window of n, at a similarity of 0.8."""
    return n // 5 if n >= 6 else 0


def seed_masks(n: int) -> list[tuple[int, ...]]:
    """Offsets of the words that each mask looks at. Greedy: together they hit every allowed pattern of differences."""
    differ = allowed(n)
    weight = 6 if n >= WINDOW else 4 if n >= 10 else 3 if n >= 6 else n
    if not differ:
        return [tuple(range(weight))]
    left = set(combinations(range(n), differ))
    choices = [(0, *mid, last) for last in range(weight - 1, n - 2) for mid in combinations(range(1, last), weight - 2)]
    hits = {c: {p for p in left if any(not {i + o for o in c} & set(p) for i in range(n - c[-1]))} for c in choices}
    found = []
    while left:
        best = max(choices, key=lambda c: len(hits[c] & left))
        found.append(best)
        left -= hits[best]
    return found


def _seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Seed hashes at each word that has a whole span of the mask after it."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    salt = np.uint64(sum(1 << o for o in mask) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    total = np.full(n, salt, np.uint64)
    for i, o in enumerate(mask):
        total += h[o : o + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1)) & (1 << 64) - 1)
    return K.mix(total)


def _around(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, fill: int) -> pa.Array:
    """SIDE word hashes before and SIDE from each place, ``fill`` beyond its row."""
    where = at[:, None] + np.arange(-SIDE, SIDE)[None, :]
    real = (where >= lo[:, None]) & (where < hi[:, None])
    out = np.where(real, h[np.clip(where, 0, max(len(h) - 1, 0))] | np.uint64(2), np.uint64(fill)) if len(at) else np.empty((0, 2 * SIDE), np.uint64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16 * SIDE), len(at), [None, pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.binary())


def _rows(masks_of, bloom) -> object:
    """Seed rows; masks_of(words in the row) gives its masks, ``bloom`` (or None) drops seeds no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value if bloom is not None else None
        size = (len(bits) * 8).bit_length() - 1 if bits is not None else 0
        low = np.uint64((1 << size) - 1)
        held = lambda p: bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 > 0
        for batch in batches:
            ids = batch.column(0)
            for row, _, data, offsets in K.chunks(batch):
                lower = K.LOWER[data]
                starts, ends, first = K.words(lower, offsets, punctuation=True)
                h = K.span_hash(K.prefix(lower), starts, ends)
                sizes = np.diff(first)
                for n, masks in masks_of(sizes):
                    for mask in masks:
                        seed = _seeds(h, mask)
                        if bits is not None:
                            at = np.flatnonzero(held(seed & low))
                            at = at[held(seed[at] >> np.uint64(size) & low)]
                        else:
                            at = np.arange(len(seed))
                        doc = np.searchsorted(first, at, "right") - 1
                        ok = at + mask[-1] < first[doc + 1]
                        if bits is None:
                            ok &= np.minimum(sizes[doc], WINDOW) == n
                        at, doc = at[ok], doc[ok]
                        fill = 0 if bits is not None else 1
                        cols = [pa.array(seed[at].view(np.int64)), ids.take(pa.array(row + doc)), pa.array((at - first[doc]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), _around(h, at, first[doc], first[doc + 1], fill)]
                        yield pa.RecordBatch.from_arrays(cols, names=["seed", "id", "at", "n", "words"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = lambda b, c: np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.uint64).reshape(-1, 2 * SIDE)
    for batch in batches:
        doc, item = shape(batch, "words"), shape(batch, "item_words")
        at, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("at", "n"))
        real = (doc != 0) & (item != 1)
        total = lambda m: np.concatenate((np.zeros((len(m), 1), np.int64), np.cumsum(m, axis=1)), axis=1)
        same, inside = total(doc == item), total(real)
        first, last, best = np.full(len(n), 99), np.full(len(n), -1), np.zeros(len(n), np.int64)
        for size in np.unique(n).tolist():
            rows = np.flatnonzero(n == size)
            hits = same[rows, size:] - same[rows, : 2 * SIDE + 1 - size]
            good = (hits >= size - allowed(size)) & (inside[rows, size:] - inside[rows, : 2 * SIDE + 1 - size] == size)
            first[rows] = np.where(good.any(axis=1), good.argmax(axis=1), 99)
            last[rows] = np.where(good.any(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + size, -1)
            best[rows] = np.where(good, hits, 0).max(axis=1)
        ok = np.flatnonzero(last >= 0)
        take = lambda c: batch.column(batch.schema.get_field_index(c)).take(pa.array(ok))
        cols = [take("id"), take("item_id"), pa.array((at[ok] - SIDE + first[ok]).astype(np.int32)), pa.array((at[ok] - SIDE + last[ok]).astype(np.int32)), pa.array(best[ok].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "first_word", "end_word", "matched"])


def _spans(text: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Agreeing spans of ``text`` (id, text), an id's own under ``doc_id``."""
    spark = text.sparkSession
    masks = {n: seed_masks(n) for n in range(1, WINDOW + 1)}
    schema = "seed long, id long, at int, n int, words binary"
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    own = lambda sizes: [(n, masks[n]) for n in np.unique(np.minimum(sizes, WINDOW)).tolist() if n]
    seeds = items.mapInArrow(_rows(own, None), schema).select("seed", F.col("id").alias("item_id"), F.col("at").alias("item_at"), "n", F.col("words").alias("item_words"))
    seeds = materialize(seeds)
    # Sixteen bits for each seed, and the item sizes present. The filter's words are the only rows that the driver takes.
    size = min(BLOOM_MOST, max(BLOOM_LEAST, (16 * seeds.count()).bit_length()))
    low = F.lit((1 << size) - 1)
    places = F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", size).bitwiseAND(low))
    marked = seeds.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("bits"))
    got = marked.toPandas()
    packed = np.zeros(1 << (size - 5), "<u4")
    packed[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    bloom = spark.sparkContext.broadcast(packed.view(np.uint8))
    sizes = sorted(r.n for r in seeds.select("n").distinct().collect())  # 13 at most
    present = [(n, masks[n]) for n in sizes]
    found = materialize(text.mapInArrow(_rows(lambda _: present, bloom), schema))
    hits = join_salted(found, seeds, ["seed", "n"], "id", "at").select("id", "at", "n", "words", "item_id", "item_words")
    return hits.mapInArrow(_verify, "doc_id long, item_id long, first_word int, end_word int, matched int")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, end_word (bounds of the agreeing words), matched (most in one window)."""
    spans = _spans(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), benchmark)
    return spans.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without an overlap, with all their columns. Rows are known by a 64-bit hash of doc_id and text.

    Null and repeated ids are decided by row; rows equal in both go or stay together; an empty benchmark leaves all.
    """
    dirty = _spans(docs.select(row_hash().alias("id"), F.col("text").cast("string").alias("text")), benchmark)
    dirty = materialize(dirty.select(F.col("doc_id").alias("key")).distinct())
    return matching(docs.select(row_hash().alias("key"), F.struct("*").alias("row")), dirty, "key", "left_anti").select("row.*")
