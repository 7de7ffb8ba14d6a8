"""Repeated byte strings through a sparse, range-partitioned suffix array.

Of all suffixes, those that start at content-chosen marks (``kernels.anchors``) are
kept: every ``window``-byte string holds a mark, at the same offset wherever the
string recurs. Marks whose leading bytes recur send a suffix, and the reversed
prefix before it, to a range of leading bytes; sampled splitters bound the ranges,
and all suffixes with equal leading bytes meet in one range, so no comparison is
lost at a boundary. Each range sorts its suffixes and its prefixes locally by
multikey quicksort on eight-byte keys; common-prefix lengths of neighbours then tell
for each offset which strings are equal and which of them starts first.

Before the shuffle, marks with equal surroundings within a chunk are settled there
but for the earliest, so a passage that very many documents share sends few rows.

Defined results: null text counts as empty; matches stay within rows; null ids sort
first; a place is an id and a start, so strings of rows with one id that start at one offset tie,
whatever the rest of their texts, and none of them removes the other; a very long text
is processed whole, its suffixes cut to what one string needs; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm import spans as S
from tidemark.llm.skew import join_counted
from tidemark.llm.store import discard, materialize

#: Bytes of suffix records that one range should hold; sampled heads behind the splitters, at least and for each range.
RANGE_BYTES, SAMPLE, HEADS = 12 << 20, 8192, 8


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows (n, width). Each pass sorts, by the next eight bytes, only the runs still tied."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order, run, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for depth in range(keys.shape[1]):
        if len(tied) < 2:
            break
        key = keys[order[tied], depth]
        sub = np.lexsort((key, run[tied]))
        order[tied], key = order[tied][sub], key[sub]
        new = np.ones(len(tied), bool)
        new[1:] = (run[tied][1:] != run[tied][:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(tied)))
        run[tied] = np.repeat(tied[begin], size)
        tied = tied[np.repeat(size > 1, size)]
    return order


def _neighbours(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in the order."""
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _mark_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy() for i in range(2))
            for row, _, data, offsets in K.chunks(batch):
                grams = K.gram_hash(K.prefix(data), k)
                at = K.anchors((grams >> np.uint64(32)).astype(np.uint32), window - k + 1, offsets, k)
                doc = np.searchsorted(offsets, at, "right") - 1
                key = grams[at].view(np.int64)
                cols = [pa.array(key), pa.array(ids[row + doc]), pa.array(ths[row + doc]), pa.array((at - offsets[doc]).astype(np.int32))]
                # The sample is chosen by place, not by content, so that common strings weigh more.
                sampled = (K.mix(ids[row + doc].view(np.uint64) * np.uint64(31) + at.astype(np.uint64)) & np.uint64(255)) == 0
                heads = np.lib.stride_tricks.sliding_window_view(data, k)[at[sampled]].tobytes() if sampled.any() else b""
                column = np.full(len(at), None, object)
                column[sampled] = [heads[i : i + k] for i in range(0, len(heads), k)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(column, pa.binary())], names=["key", "id", "th", "pos", "head"])

    return run


def _equal_bytes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether data[lo:hi] equals data[lo2:hi2], for the rows ``which``; true for all others."""
    out = np.ones(len(lo), bool)
    size = hi[which] - lo[which]
    good = size == hi2[which] - lo2[which]
    for step in range(int(size.max(initial=0))):
        inside = np.minimum(step, size - 1)
        good[good] = data[(lo[which] + inside)[good]] == data[(lo2[which] + inside)[good]]
    out[which] = good
    return out


def _suffix_rows(window: int, k: int, splitters: list[bytes]):
    bounds = np.array(splitters, f"S{k}") if splitters else np.empty(0, f"S{k}")
    left, names = window - k, ["bucket", "id", "th", "pos", "pre", "suf", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy() for i in range(2))
            lists, (pos,) = S.list_of(batch, "pos")
            for row, end, data, offsets in K.chunks(batch):
                doc = np.repeat(np.arange(end - row), np.diff(lists[row : end + 1]))
                rel = pos[lists[row] : lists[end]].astype(np.int64)
                at, d_id, d_th = offsets[doc] + rel, ids[row + doc], ths[row + doc]
                lo, hi = np.maximum(at - left, offsets[doc]), np.minimum(at + window, offsets[doc + 1])
                sums = K.prefix(data)
                around = K.mix(K.span_hash(sums, lo, hi) + (at - lo).astype(np.uint64))
                order = np.lexsort((rel, d_id, around))
                head = np.ones(len(at), bool)
                head[1:] = around[order][1:] != around[order][:-1]
                first = order[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
                same = (d_id[order] == d_id[first]) & (rel[order] == rel[first])
                # What the hashes call equal is settled here only if its bytes are.
                same |= ~_equal_bytes(data, lo[order], hi[order], lo[first], hi[first], np.flatnonzero(~same))
                early = np.zeros(len(at), bool)
                early[order] = same
                late = np.flatnonzero(~early)
                sent = np.flatnonzero(early)
                src = at[sent]
                suf = [data[a:b].tobytes() for a, b in zip(src.tolist(), hi[sent].tolist(), strict=True)]
                pre = [data[a:b][::-1].tobytes() for a, b in zip(lo[sent].tolist(), src.tolist(), strict=True)]
                bucket = np.searchsorted(bounds, np.array([s[:k] for s in suf], f"S{k}"), "right").astype(np.int32) if suf else np.empty(0, np.int32)
                which, none = np.concatenate((sent, late)), [None] * len(late)
                low = np.where(early[which], 0, lo[which] - offsets[doc[which]]).astype(np.int32)
                high = np.where(early[which], 0, hi[which] - offsets[doc[which]] - window).astype(np.int32)
                cols = [pa.array(np.concatenate((bucket, np.full(len(late), -1, np.int32)))), pa.array(d_id[which]), pa.array(d_th[which]), pa.array(rel[which].astype(np.int32)), pa.array(pre + none, pa.binary()), pa.array(suf + none, pa.binary()), pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _matrix(col: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as zero-padded rows, and their lengths."""
    flat = col.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    size = np.diff(at)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(flat) else np.empty(0, np.uint8)
    out = np.zeros((len(flat), width), np.uint8)
    out[np.arange(width)[None, :] < size[:, None]] = data
    return out, size


def _settle(window: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, ths, pos = (table.column(c).to_numpy() for c in ("id", "th", "pos"))
        order = np.lexsort((ths, pos, ids))  # from here on rows stand by place, the earliest first
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(ids[order]) != 0) | (np.diff(pos[order]) != 0) | (np.diff(ths[order]) != 0)
        order = order[once]
        ids, ths, pos, table = ids[order], ths[order], pos[order], table.select(["pre", "suf"]).take(pa.array(order))
        place = np.concatenate(([0], np.cumsum((np.diff(ids) != 0) | (np.diff(pos) != 0)))) if len(ids) else ids
        (suf, n_suf), (pre, n_pre) = _matrix(table.column("suf"), window), _matrix(table.column("pre"), window - k)
        by_suf, by_pre = multikey_sort(suf), multikey_sort(pre)
        lcp, lcs, n = _neighbours(suf, by_suf), _neighbours(pre, by_pre), len(ids)
        repeated = np.zeros((n, window - k + 3), bool)  # column e + 1: the string that starts e bytes before the mark

        def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
            out = np.empty(n, np.int64)
            out[order] = np.concatenate(([0], np.cumsum(common < depth)))
            return out

        for e in range(window - k + 1):
            real = np.flatnonzero((n_pre >= e) & (n_suf >= window - e))
            if len(real) < 2:
                continue
            kind = (classes(by_suf, lcp, window - e) * n + classes(by_pre, lcs, e))[real]
            by_kind = np.argsort(kind, kind="stable")
            own = real[by_kind]
            heads = np.append(True, kind[by_kind][1:] != kind[by_kind][:-1])
            leader = own[np.maximum.accumulate(np.where(heads, np.arange(len(own)), 0))]
            repeated[own[place[own] != place[leader]], e + 1] = True
        step = np.diff(repeated.astype(np.int8), axis=1)
        row, e1 = np.nonzero(step == 1)
        e2 = np.nonzero(step == -1)[1] - 1
        cols = [ids[row], ths[row], (pos[row] - e2).astype(np.int32), (pos[row] - e1).astype(np.int32)]
        return pa.table([pa.array(c) for c in cols], names=["id", "th", "lo", "hi"])

    return run


def repeated_strings(docs: DataFrame, window: int = 100, k: int = 24) -> DataFrame:
    """(id, th, lo, hi): spans of starts, in bytes, of ``window``-byte strings that also start earlier."""
    marks = S.keyed(docs).select("id", "th", "text").mapInArrow(_mark_rows(window, k), "key long, id long, th long, pos int, head binary")
    recur = marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    marked = materialize(join_counted(marks, materialize(recur), "key", "id", "pos").drop("key"))
    ranges = max(1, math.ceil(marked.count() * (2 * window) / RANGE_BYTES))
    sample = marked.where("head is not null").orderBy(F.xxhash64("id", "pos"), "id", "pos").limit(max(SAMPLE, HEADS * ranges)).select("head").collect()
    heads = sorted(bytes(r.head) for r in sample)
    splitters = sorted({heads[len(heads) * i // ranges] for i in range(1, ranges)}) if heads else []
    joined = S.with_lists(S.keyed(docs), marked, "inner", "pos").select("id", "th", "text", "found")
    schema = "bucket int, id long, th long, pos int, pre binary, suf binary, lo int, hi int"
    rows = materialize(joined.mapInArrow(_suffix_rows(window, k, splitters), schema))
    discard(marked)
    sent = rows.where("bucket >= 0").select("bucket", "id", "th", "pos", "pre", "suf")
    settled = sent.repartition(max(len(splitters) + 1, 1), "bucket").groupBy("bucket").applyInArrow(_settle(window, k), "id long, th long, lo int, hi int")
    found = materialize(settled.unionByName(rows.where("bucket < 0").select("id", "th", "lo", "hi")))
    discard(rows)
    return found


def _cut_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, (lo, hi) = S.list_of(batch, "lo", "hi")
            counts, sha, texts = [np.empty((0, 3), np.int64)], [], []
            for row, end, data, offsets in K.chunks(batch):
                part = slice(lists[row], lists[end])
                base = offsets[np.repeat(np.arange(end - row), np.diff(lists[row : end + 1]))]
                gone = S.covered(len(data), base + lo[part], base + hi[part] + window)
                before = np.concatenate(([False], gone[:-1]))
                before[offsets[:-1][offsets[:-1] < len(data)]] = False
                total = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[offsets])  # noqa: E731, B023
                kept = data[~gone].tobytes()
                bounds = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                counts.append(np.stack((np.diff(offsets), total(gone), total(gone & ~before)), axis=1))
                sha += S.digests(kept, bounds)
                if with_text:
                    texts += [kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            found = np.concatenate(counts)
            cols = [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(found[:, i]) for i in range(3)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * with_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return run


def suffix_dedup(docs: DataFrame, window: int = 100, with_text: bool = False) -> DataFrame:
    """Remove each byte that an earlier-starting ``window``-byte string covers (, kept: the bytes left)."""
    joined = S.with_lists(S.keyed(docs), repeated_strings(docs, window), "left", "lo", "hi")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.select("doc_id", "text", "found").mapInArrow(_cut_rows(window, with_text), schema)
