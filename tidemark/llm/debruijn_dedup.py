"""Repeated word windows through a compacted de Bruijn graph.

The graph's nodes are the k-word runs that ``kernels.anchors`` marks: at least one
in every window, the same ones wherever a window's words recur. An edge joins a
run to the next one marked in a document and carries a hash of all words from one to
the other. A join with the nodes' degree table tells which nodes recur and where
paths branch; unbranched edges between recurring nodes compact into paths, whose
occurrences all have the same words, so any window inside one recurs. Only windows
that cross a path's end and hold a recurring node are counted whole. At their source
coordinates the words are hashed again, from their bytes on and with another base, so that two windows
are taken for equal by 128 bits only; inside a path a node's and an edge's hash agree, 128 bits as well.
Source coordinates then carry the verdicts back to the documents.

Defined results: a null or empty text has no words; a very long text is one row of words like any other; matches
stay within rows; two rows that are equal repeat one another; a null doc_id is kept as null; ties don't arise; an
empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm import spans as S
from tidemark.llm.skew import join_counted
from tidemark.llm.store import materialize


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = K.words(data, offsets)
    return starts, ends, first, K.span_hash(K.prefix(data), starts, ends)


def _node_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy() for i in range(2))
            for row, _, data, offsets in K.chunks(batch):
                _, _, first, h = _word_hashes(data, offsets)
                sums = K.word_sums(h)
                grams = K.gram_hash(sums, k)
                at = K.anchors((grams >> np.uint64(32)).astype(np.uint32), window - k + 1, first, k)
                doc = np.searchsorted(first, at, "right") - 1
                edge = np.zeros(len(at) + 1, np.uint64)  # edge[i]: from node i - 1 to node i
                if len(at) > 1:
                    edge[1:-1] = K.span_hash(sums, at[:-1], at[1:] + k) * (doc[1:] == doc[:-1]) ^ (at[1:] - at[:-1]).astype(np.uint64) * (doc[1:] == doc[:-1])
                cols = [grams[at].view(np.int64), ids[row + doc], ths[row + doc], (at - first[doc]).astype(np.int32), edge[1:].view(np.int64), edge[:-1].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", "th", "pos", "nxt", "prv"])

    return run


def _window_rows(window: int, k: int):
    """Of the rows with recurring nodes: spans of window starts proven by a path (words null), and windows to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy() for i in range(2))
            lists, (pos, follows, preceded) = S.list_of(batch, "pos", "out1", "in1")
            for row, end, data, offsets in K.chunks(batch):
                starts, ends, first, h = _word_hashes(data, offsets)
                part = slice(lists[row], lists[end])
                doc = np.repeat(np.arange(end - row), np.diff(lists[row : end + 1]))
                at, out1, in1 = first[doc] + pos[part], follows[part], preceded[part]
                once = np.ones(len(at), bool)
                once[1:] = at[1:] != at[:-1]  # equal rows share a list
                at, out1, in1, doc = at[once], out1[once], in1[once], doc[once]
                linked = out1[:-1] & in1[1:] & (doc[1:] == doc[:-1])
                head = np.flatnonzero(np.concatenate(([True], ~linked)))
                tail = np.append(head[1:] - 1, len(at) - 1)
                lo, hi = at[head], at[tail] + k - window  # first and last window start inside the path
                whole = hi >= lo
                lo, hi, path_doc = lo[whole], hi[whole], doc[head][whole]
                inside = S.covered(len(h), lo, hi + 1)
                near_lo = np.maximum(at + k - window, first[doc])
                near_hi = np.minimum(at, first[doc + 1] - window)
                ok = near_hi >= near_lo
                near = S.covered(len(h), near_lo[ok], near_hi[ok] + 1)
                s = np.flatnonzero(near & ~inside)
                wh = K.span_hash(K.word_sums(h), s, s + window)
                again = K.span_hash(K.prefix(data, K.OTHER), starts, ends, K.OTHER) if len(s) else h
                wv = K.span_hash(K.word_sums(again, K.OTHER), s, s + window, K.OTHER)
                s_doc = np.searchsorted(first, s, "right") - 1
                d = np.concatenate((path_doc, s_doc))
                key = [pa.array(np.concatenate((np.zeros(len(lo), np.int64), x.view(np.int64)))) for x in (wh, wv)]
                cols = [
                    pa.StructArray.from_arrays(key, ["h", "v"], mask=pa.array(np.arange(len(d)) < len(lo))),
                    pa.array(ids[row + d]), pa.array(ths[row + d]),
                    pa.array((np.concatenate((lo, s)) - first[d]).astype(np.int32)),
                    pa.array((np.concatenate((hi, s)) - first[d]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["words", "id", "th", "lo", "hi"])

    return run


def _cut_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, (lo, hi) = S.list_of(batch, "lo", "hi")
            n_words, n_removed, sha, texts = [], [], [], []
            for row, end, data, offsets in K.chunks(batch):
                starts, ends, first = K.words(data, offsets)
                part = slice(lists[row], lists[end])
                base = first[np.repeat(np.arange(end - row), np.diff(lists[row : end + 1]))]
                gone = S.covered(len(starts), base + lo[part], base + hi[part] + window)
                kept = np.flatnonzero(~gone)
                size = ends[kept] - starts[kept] + 1
                at = np.concatenate(([0], np.cumsum(size)))
                flat = np.append(data, np.uint8(32))[K.take_ranges(starts[kept], size)]
                flat[at[1:] - 1] = 32
                rows = np.searchsorted(kept, first)
                a, b = at[rows[:-1]], at[rows[1:]]
                b = np.where(b > a, b - 1, b)  # no space after the last word
                buf = flat.tobytes()
                piece = [buf[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                sha += [x for p in piece for x in S.digests(p, np.array([0, len(p)]))]
                if with_text:
                    texts += [p.decode() for p in piece]
                n_words.append(np.diff(first))
                n_removed.append(np.diff(np.concatenate(([0], np.cumsum(gone)))[first]))
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(cat(n_words), pa.int64()), pa.array(cat(n_removed), pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def repeated_windows(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """(id, th, lo, hi): spans of window starts, in words, whose windows start anywhere else too."""
    nodes = S.keyed(docs).select("id", "th", "text").mapInArrow(_node_rows(window, k), "key long, id long, th long, pos int, nxt long, prv long")
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)  # noqa: E731  unbranched: the same edge at every occurrence
    degree = nodes.groupBy("key").agg(F.count("*").alias("n"), one("nxt").alias("out1"), one("prv").alias("in1")).where("n > 1")
    recurring = join_counted(nodes.select("key", "id", "th", "pos"), materialize(degree), "key", "id", "pos")
    joined = S.with_lists(S.keyed(docs), recurring, "inner", "pos", "out1", "in1")
    rows = materialize(joined.select("id", "th", "text", "found").mapInArrow(_window_rows(window, k), "words struct<h:long,v:long>, id long, th long, lo int, hi int"))
    counted = rows.where("words is not null")
    again = counted.groupBy("words").agg(F.count("*").alias("n")).where("n > 1")
    return rows.where("words is null").drop("words").unionByName(join_counted(counted, materialize(again), "words", "id", "lo").drop("words"))


def substring_dedup(docs: DataFrame, window: int = 35, k: int = 8, with_text: bool = False) -> DataFrame:
    """Remove each word that a repeated window covers: doc_id, n_words, n_removed, kept_sha256 (, kept_text)."""
    joined = S.with_lists(S.keyed(docs), repeated_windows(docs, window, k), "left", "lo", "hi")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", "found").mapInArrow(_cut_rows(window, with_text), schema)
