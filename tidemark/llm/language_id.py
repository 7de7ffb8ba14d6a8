"""Language identification by mixture inference.

Every word of a document is taken to come from one language, drawn by the document's
own proportions. A word's likelihood under a language is that of its letters, each
given the two bytes before it, from counts of hashed byte trigrams. Expectation
maximisation estimates the proportions; then the language set grows by the next
likeliest language for as long as the penalised log likelihood of the mixture rises.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where
no labelled rows exist; equal likelihoods go to the language that sorts first; rows
with a null or non-held-out doc_id hash are used to learn only if lang is known;
repeated rows count as often as they occur; a very long text is read whole, its words all weighing alike; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import kernels as K

BITS, SLICE = 17, 1 << 14
TABLE = (1 << BITS) + (1 << 16)
#: Log likelihood that each further language must add, times the logarithm of the number of words.
PENALTY = 2.0

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of a word and the one after it: trigram bucket and context; word bounds in places; words per row."""
    n = len(data)
    text = np.full(n + 3, 32, np.uint8)
    text[2 : n + 2] = np.where(_LETTER[data], K.LOWER[data], 32)
    inside = text[2:] != 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    size = ends - starts + 1
    at = K.take_ranges(starts, size)
    where = np.concatenate(([0], np.cumsum(size)))
    c = text[2:][at].astype(np.uint32)
    c[where[1:] - 1] = 32
    b, a = text[1:][at].astype(np.uint32), text[at].astype(np.uint32)
    head = where[:-1]
    b[head], a[head] = 32, 32
    nxt = head + 1  # a word has a place and an end at least
    a[nxt] = 32
    context = a << 8 | b
    bucket = ((context << 8 | c) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return bucket.astype(np.int64), context.astype(np.int64), where, np.searchsorted(starts, offsets)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table of counts for each language of the partition, in slices."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        for row, end, data, offsets in K.chunks(batch):
            bucket, context, where, first = _grams(data, offsets)
            own = langs[row:end]
            for lang in dict.fromkeys(own.tolist()):
                mine = np.repeat(np.repeat(own == lang, np.diff(first)), np.diff(where))
                table = tables.setdefault(lang, np.zeros(TABLE, np.int64))
                table[: 1 << BITS] += np.bincount(bucket[mine], minlength=1 << BITS)
                table[1 << BITS :] += np.bincount(context[mine], minlength=1 << 16)
    for lang, table in tables.items():
        cut = [table[i : i + SLICE].tobytes() for i in range(0, TABLE, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["lang", "part", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for chunk in table.column("counts").to_pylist():
        total += np.frombuffer(chunk, np.int64)
    return pa.table({"lang": [table.column("lang")[0].as_py()], "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(labelled: DataFrame, most: int = 400_000) -> tuple[list[str], np.ndarray]:
    """Languages and log weights (TABLE x languages) from text and lang of ``labelled``.

    ``most`` bounds the rows to learn from; above it a share of them is taken by a hash of
    doc_id. A table has a fixed size, so what a task sends doesn't grow with its rows.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = most / max(labelled.where("lang is not null").count(), 1)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = rows.select("text", "lang").mapInArrow(_count_rows, "lang string, part int, counts binary")
    got = counts.groupBy("lang", "part").applyInArrow(_add, "lang string, part int, counts binary").collect()
    langs = sorted({r.lang for r in got})
    full = np.zeros((TABLE, len(langs)))
    for r in got:
        full[r.part * SLICE : (r.part + 1) * SLICE, langs.index(r.lang)] = np.frombuffer(bytes(r.counts), np.int64)[: TABLE - r.part * SLICE]
    full[: 1 << BITS] = np.log(full[: 1 << BITS] + 0.05)
    full[1 << BITS :] = -np.log(full[1 << BITS :] + 0.05 * 64)
    return langs, full.astype(np.float32)


def _maximise(like: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per row after some steps of expectation maximisation, and log of each row's mixture."""
    n = np.diff(first)
    for _ in range(steps):
        part = like * np.repeat(share, n, axis=0)
        total = part.sum(axis=1)
        part /= np.maximum(total, 1e-30)[:, None]
        share = np.add.reduceat(part, first[:-1], axis=0) / n[:, None]
    total = (like * np.repeat(share, n, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first[:-1])


def infer(word_ll: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, chosen): per row with words the languages' shares and the set of those selected."""
    n, count = np.diff(first), word_ll.shape[1]
    top = word_ll.max(axis=1, keepdims=True)
    like = np.exp(word_ll - top)
    share, _ = _maximise(like, first, np.full((len(n), count), 1 / count, np.float32), 6)
    single = np.add.reduceat((word_ll - top).astype(np.float64), first[:-1], axis=0)
    lead = single.argmax(axis=1)
    best = single.max(axis=1)
    chosen = np.zeros((len(n), count), bool)
    chosen[np.arange(len(n)), lead] = True
    ranked = share.copy()
    ranked[np.arange(len(n)), lead] = 2
    order = np.argsort(-ranked, axis=1, kind="stable")
    open_rows = np.flatnonzero(np.where(chosen, 0, share).max(axis=1) > 0.005)
    for size in range(2, count + 1):
        if not len(open_rows):
            break
        allowed = np.zeros((len(open_rows), count), bool)
        np.put_along_axis(allowed, order[open_rows, :size], True, axis=1)
        own = K.take_ranges(first[:-1][open_rows], n[open_rows])
        cut = np.concatenate(([0], np.cumsum(n[open_rows])))
        part, value = _maximise(like[own], cut, (allowed / size).astype(np.float32), 12)
        gain = value - best[open_rows] > PENALTY * np.log(n[open_rows] + 1)
        rows = open_rows[gain]
        chosen[rows], share[rows], best[rows] = allowed[gain], part[gain], value[gain]
        open_rows = rows
    return share, chosen


def _predict_rows(langs: list[str], weights) -> object:
    names = np.array(langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        # Small slices, as a whole row may be passed on with each prediction.
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            col = batch.column(batch.schema.get_field_index("text")) if "text" in batch.schema.names else batch.column(batch.schema.get_field_index("row")).field("text")
            pred, score, sets = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.full(batch.num_rows, "", object)
            for row, _, data, offsets in K.pieces(col, 1 << 20):
                bucket, context, where, first = _grams(data, offsets)
                if not len(bucket):
                    continue
                ll = np.add.reduceat(w[bucket] + w[(1 << BITS) + context], where[:-1], axis=0)
                rows = np.flatnonzero(np.diff(first))
                share, chosen = infer(ll, np.append(first[rows], first[-1]))
                share = np.where(chosen, share, 0)
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
                lead = share.argmax(axis=1)
                pred[row + rows], score[row + rows] = names[lead], share[np.arange(len(rows)), lead]
                many = chosen.sum(axis=1) > 1
                sets[row + rows] = names[lead]
                for i in np.flatnonzero(many).tolist():
                    sets[row + rows[i]] = ",".join(names[chosen[i]])
            letters = batch.column(batch.schema.get_field_index("letters")).fill_null(False).to_numpy(zero_copy_only=False)
            pred[~letters], score[~letters], sets[~letters] = "und", 0.0, ""
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "letters")]
            cols = [*(batch.column(i) for i in kept), pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(batch.schema.names[i] for i in kept), "lang_pred", "score", "lang_set"])

    return run


def identify(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set (comma-separated) for every row (, row: the whole input row).

    Learns from the text and lang of rows with crc32(doc_id as text) mod 4 other than 2.
    """
    spark = docs.sparkSession
    langs, weights = fit(docs.where(~held_out(4, 2)))
    text = F.col("text").cast("string").alias("text")
    passed = F.struct(*[text if c == "text" else F.col(c) for c in docs.columns]).alias("row") if with_row else text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), passed, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not langs:
        return rows.select("doc_id", "held_out", *["row"] * with_row, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("").alias("lang_set"))
    shared = spark.sparkContext.broadcast(weights)
    schema = StructType([f for f in rows.schema if f.name not in ("text", "letters")]).add("lang_pred", "string").add("score", "double").add("lang_set", "string")
    return rows.mapInArrow(_predict_rows(langs, shared), schema)
