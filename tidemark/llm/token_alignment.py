"""Two tokenizers side by side: groups of tokens between common ends, and their links.

Each text is encoded by both; the byte offsets where tokens of both end cut it into groups.
Within a group no inner ends meet, so n + m tokens have n + m - 1 overlapping pairs, its links.
A group is written as its ids, ``a1,a2|b1``, which says all about it and so is its key.

Texts are worked on in blocks of some megabytes. A block interns its distinct groups and
counts, for each linked pair of ids, its documents that hold it. The counts of all blocks add up to the
corpus's; the most frequent partner of each A id follows, a table no longer than A's
vocabulary. The distinct groups of all blocks make up the dictionary: their links are expanded once
for each, joined with the pairs' counts and summed by group. These sums go back to the
blocks by group key, one row for each block and group however often it occurs there, and a
block multiplies them by the frequencies in each of its documents.

Defined results: null and empty texts, and texts whose tokens don't spell them, have no tokens: zeros, and an empty string
for the groups; very long texts are whole, a block of their own; equal rows count as documents each; ties for the most frequent
partner are all best; an empty table gives no rows; a null doc_id stays null; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.encoders import byte_letters, public_path, space_chunks
from tidemark.llm.store import materialize
from tidemark.llm.token_shards import PATTERN

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks that a task remembers at most.
REMEMBERED = 600_000
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
DOCUMENT, GROUP, PAIR = 0, 1, 2
_FIELDS = "kind int, block long, i int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, key string, a int, b int, n long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _FIELDS.split(", ")])


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the groups of text chunks, each known by a number.

    The byte-level vocabulary is its ids in the order of their merges, so it is encoded by its ranks.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {i: x for x, i in ranks.items()}
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.forget()

    def forget(self) -> None:
        self.chunk_no: dict[str, int] = {}
        self.joined: list[str] = []
        self.counts: list[tuple[int, int]] = []
        self.groups: list[list[int]] = []
        self.group_no: dict[str, int] = {}
        self.keys: list[str] = []
        self.bad: set[int] = set()

    def keys_of(self, a: list[int], b: list[int], text: bytes) -> list[str] | None:
        """The groups' keys in order, or None where the tokens don't spell ``text``."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if not a or b"".join(parts_a) != text or b"".join(parts_b) != text:
            return None
        out, j, from_a, from_b = [], 0, 0, 0
        end_a = end_b = 0
        for i, part in enumerate(parts_a, 1):
            end_a += len(part)
            while end_b < end_a:
                end_b += len(parts_b[j])
                j += 1
            if end_a == end_b:
                out.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                from_a, from_b = i, j
        return out

    def learn(self, chunks: set[str]) -> None:
        """Number all ``chunks``; what is known is forgotten where it grows too large, but never between them."""
        new = [c for c in chunks if c not in self.chunk_no]
        if len(self.chunk_no) + len(new) > REMEMBERED:
            self.forget()
            new = list(chunks)
        for c, b in zip(new, self.b.encode(new, num_threads=1) if new else [], strict=True):
            spaced = " " + c
            a = self.a(spaced)
            keys = self.keys_of(a, b, spaced.encode())
            self.chunk_no[c] = len(self.joined)
            if keys is None:
                self.bad.add(len(self.joined))
            self.joined.append(";".join(keys or ()))
            self.counts.append((len(a), len(b)))
            own = []
            for k in keys or ():
                at = self.group_no.get(k)
                if at is None:
                    at = self.group_no[k] = len(self.keys)
                    self.keys.append(k)
                own.append(at)
            self.groups.append(own)

    def numbered(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's chunks; none for a text without tokens."""
        cut = [space_chunks(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        found = [[self.chunk_no[c] for c in chunks] for chunks in cut]
        return [[] if self.bad and not self.bad.isdisjoint(own) else own for own in found]


def links_of(key: str, length_a: dict | list, length_b: list) -> Iterator[tuple[int, int]]:
    """The overlapping (A id, B id) occurrences of a group, in order."""
    left, right = key.split("|")
    a, b = [int(x) for x in left.split(",")], [int(x) for x in right.split(",")]
    i = j = 0
    end_a, end_b = length_a[a[0]], length_b[b[0]]
    while True:
        yield a[i], b[j]
        if end_a <= end_b:
            i += 1
            if i == len(a):
                return
            if end_a == end_b:
                j += 1
                end_b += length_b[b[j]]
            end_a += length_a[a[i]]
        else:
            j += 1
            end_b += length_b[b[j]]


def _rows(kind: int, rows: int, **columns) -> pa.RecordBatch:
    own = {"kind": np.full(rows, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _blocks(path_a: str, path_b: str, block_bytes: int) -> object:
    """Rows of documents, of a block's distinct groups and of its pairs, each as its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        length_a, length_b = {i: len(x) for i, x in aligner.bytes_a.items()}, [len(x) for x in aligner.bytes_b]
        for batch in batches:
            for begin, end, _, _ in K.chunks(batch, limit=block_bytes):
                part = batch.slice(begin, end - begin)
                yield from _one_block(part, number, aligner, length_a, length_b)
                number += 1

    return run


def _one_block(part: pa.RecordBatch, number: int, aligner: Aligner, length_a: dict, length_b: list) -> Iterator[pa.RecordBatch]:
    of_doc = aligner.numbered(part.column(1).to_pylist())
    joined = aligner.joined
    digests = [hashlib.sha256(";".join([joined[c] for c in own]).encode()).hexdigest() if own else "" for own in of_doc]
    # The block's own numbers of its chunks and groups.
    doc_of_chunk = np.repeat(np.arange(len(of_doc)), [len(own) for own in of_doc])
    chunks, seen = np.unique(np.fromiter((c for own in of_doc for c in own), np.int64, len(doc_of_chunk)), return_inverse=True)
    groups_of_chunk = [aligner.groups[c] for c in chunks.tolist()]
    size = np.array([len(g) for g in groups_of_chunk], np.int64)
    ids, flat = np.unique(np.array([g for own in groups_of_chunk for g in own], np.int64), return_inverse=True)
    keys = [aligner.keys[g] for g in ids.tolist()]
    tokens = np.array([aligner.counts[c] for c in chunks.tolist()], np.int64).reshape(-1, 2)
    n_a, n_b, n_groups = (np.zeros(len(of_doc), np.int64) for _ in range(3))
    for total, each in ((n_a, tokens[:, 0]), (n_b, tokens[:, 1]), (n_groups, size)):
        np.add.at(total, doc_of_chunk, each[seen])
    # All groups of all documents in turn, then the distinct ones of each document with their number.
    found = flat[K.take_ranges((np.cumsum(size) - size)[seen], size[seen])] if len(seen) else flat
    doc = np.repeat(doc_of_chunk, size[seen]) if len(seen) else doc_of_chunk
    own, times = np.unique(doc * max(len(keys), 1) + found, return_counts=True)
    doc, group = own // max(len(keys), 1), own % max(len(keys), 1)
    cut = np.searchsorted(doc, np.arange(len(of_doc) + 1)) * 4
    as_bytes = lambda x: (raw := x.astype(np.uint32).tobytes()) and [raw[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] or [b""] * len(of_doc)
    yield _rows(DOCUMENT, len(of_doc), block=np.full(len(of_doc), number), i=np.arange(len(of_doc)), doc_id=part.column(0), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_a + n_b - n_groups, groups_sha256=digests, at=as_bytes(group), times=as_bytes(times))
    yield _rows(GROUP, len(keys), block=np.full(len(keys), number), i=np.arange(len(keys)), key=keys)
    # The block's pairs, numbered; a document counts once for a pair that several of its groups hold.
    pair_no: dict[tuple[int, int], int] = {}
    pairs = [[pair_no.setdefault(p, len(pair_no)) for p in dict.fromkeys(links_of(k, length_a, length_b))] for k in keys]
    size = np.array([len(p) for p in pairs], np.int64)
    flat = np.array([p for own in pairs for p in own], np.int64)
    if len(group):
        held = flat[K.take_ranges((np.cumsum(size) - size)[group], size[group])]
        once = np.unique(held * len(of_doc) + np.repeat(doc, size[group])) // len(of_doc)
        ids = np.array(list(pair_no), np.int32)
        yield _rows(PAIR, len(ids), a=ids[:, 0], b=ids[:, 1], n=np.bincount(once, minlength=len(ids)).astype(np.int64))


def align_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written rows of all blocks, a folder for each kind."""
    run = _blocks(path_a or public_path(TOKENIZER_A), path_b or public_path(TOKENIZER_B), block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, _FIELDS), ["kind"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best), written: documents that hold the pair, and whether no partner of its A id has more."""
    counted = materialize(blocks.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    return materialize(counted.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def dictionary(blocks: DataFrame) -> DataFrame:
    """(key) of every distinct group of the corpus."""
    return blocks.where(F.col("kind") == GROUP).select("key").distinct()


def group_links(keys: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(key, a, b, times): the links of each group of ``keys``, expanded once."""
    path_a, path_b = path_a or public_path(TOKENIZER_A), path_b or public_path(TOKENIZER_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        length_a, length_b = {i: len(x) for i, x in aligner.bytes_a.items()}, [len(x) for x in aligner.bytes_b]
        for batch in batches:
            key, a, b, times = [], [], [], []
            for k in batch.column(0).to_pylist():
                found: dict[tuple[int, int], int] = {}
                for p in links_of(k, length_a, length_b):
                    found[p] = found.get(p, 0) + 1
                key += [k] * len(found)
                a += [p[0] for p in found]
                b += [p[1] for p in found]
                times += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(times, pa.int64())], names=["key", "a", "b", "times"])

    return keys.mapInArrow(run, "key string, a int, b int, times long")


def group_sums(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, best, total), written: links of the group that are best, and the sum of its links' counts."""
    joined = links.join(pairs, ["a", "b"]).groupBy("key")
    return materialize(joined.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total")))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _back(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Documents of one block with their sums, by the numbers of its groups."""
    order = np.argsort(sums.column("i").to_numpy())
    best, total = (sums.column(c).to_numpy()[order] for c in ("best", "total"))
    n_best, count_sum = [], []
    for at, times in zip(docs.column("at").to_pylist(), docs.column("times").to_pylist(), strict=True):
        own, many = np.frombuffer(at, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
        n_best.append(int((best[own] * many).sum()))
        count_sum.append(int((total[own] * many).sum()))
    kept = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[f.split()[0] for f in _RESULT.split(", ")])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    blocks = align_blocks(docs, path_a, path_b, block_bytes)
    sums = group_sums(group_links(dictionary(blocks), path_a, path_b), pair_counts(blocks))
    groups = blocks.where(F.col("kind") == GROUP).select("block", "i", "key").join(sums, "key").select("block", "i", "best", "total")
    rows = blocks.where(F.col("kind") == DOCUMENT).select(F.col("block").alias("home"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    return rows.groupBy("home").cogroup(groups.groupBy("block")).applyInArrow(_back, _RESULT)
