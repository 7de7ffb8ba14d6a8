"""Token ids in training order: fixed-stride records behind a keyed permutation.

Each text is encoded once by a public byte-pair tokenizer and cut into sequences of
``length`` ids with an end mark after each text; the last one is padded. All sequences
have a dense number, from sums over documents by id; a keyed Feistel network over
the next power of four, walked until it lands below their count, sends the number to a
global slot. A shard is a range of slots; ranges of many shards are dealt to a partition by number,
with no sampling, and sorted by slot. Each shard is written as one file of bare records; a record's
place in it is its slot times the stride, so a reader can seek to any slot and go on from there.

Defined results: null and empty texts give one sequence that holds the end mark only; a very long text is
many sequences of one document; equal rows are kept and numbered one after another, and so tie in nothing
but their slots; a null id counts as the least; an empty table gives no rows and no files; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import spans as S
from tidemark.llm.skew import FEW
from tidemark.llm.store import discard, forget_at_exit, materialize, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern that cuts text before this vocabulary's merges (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END, LENGTH, PER_SHARD, KEY = 50256, 512, 4096, 20_240_601
#: Documents that are numbered in one task, shards that one task writes at most, and ranges of slots written one after another.
NUMBERED, SHARDS, ROUNDS = 4_000, 32, 4
INDEX = "slot long, shard int, byte_offset long, doc_id long, seq int, n_tokens int"
RECORD = INDEX + ", record binary"


def feistel(x: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. count - 1."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.frombuffer(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), np.uint64)[0] for r in range(rounds)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for k in keys:
            t = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            t ^= t >> np.uint64(29)
            t *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((t >> np.uint64(32)) & low)
        return a << np.uint64(half) | b

    out = once(x.astype(np.uint64))
    while (walk := np.flatnonzero(out >= count)).size:
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def _token_rows(vocabulary) -> object:
    """Ids of each text; equal rows of a batch fold to one with their number, ``m``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kind = np.uint16 if max(ranks.values(), default=0) < 65535 and END < 65536 else np.uint32
        width = np.dtype(kind).itemsize
        for batch in batches:
            times: dict[tuple, int] = {}
            at: list[int] = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                times[row] = times.get(row, 0) + 1
                if times[row] == 1:
                    at.append(i)
            many = list(times.values())
            for a in range(0, len(at), 256):
                part = batch.take(pa.array(at[a : a + 256]))
                ids = [np.array([*encode(t), END], kind).tobytes() for t in part.column(3).to_pylist()]
                cols = [*(part.column(c) for c in range(3)), pa.array(many[a : a + 256], pa.int64()), pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "doc_id", "m", "n", "ids"])

    return run


def _record_rows(count: int, key: int, length: int, per_shard: int, low: int, high: int) -> object:
    """The records of slots ``low`` to ``high`` - 1."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                n, start, m = (col(c).to_numpy() for c in ("n", "start", "m"))
                pieces = (n + length - 1) // length
                raw = col("ids").to_pylist()
                width = len(raw[0]) // int(n[0]) if len(n) else 2
                stride = 4 + length * width
                # Copies in turns, so that a row that stands for very many doesn't become one batch.
                for turn in range(int(m.max(initial=0))):
                    row = np.repeat(np.arange(len(n)), np.where(m > turn, pieces, 0))
                    seq = np.arange(len(row)) - np.repeat(np.cumsum(np.where(m > turn, pieces, 0)) - pieces * (m > turn), np.where(m > turn, pieces, 0))
                    slot = feistel(start[row] + turn * pieces[row] + seq, count, key)
                    own = np.flatnonzero((slot >= low) & (slot < high))
                    row, seq, slot = row[own], seq[own], slot[own]
                    size = np.minimum(n[row] - seq * length, length)
                    records = []
                    for i, s, k in zip(row.tolist(), seq.tolist(), size.tolist(), strict=True):
                        body = raw[i][s * length * width : (s * length + k) * width]
                        records.append(k.to_bytes(4, "little") + body + bytes((length - k) * width))
                    cols = [pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(slot % per_shard * stride), col("doc_id").take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(records, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _numbered(docs: DataFrame, tokenizer: str, length: int) -> tuple[DataFrame, DataFrame, int]:
    """The written ids of each text, the same with the number of its first sequence, and how many sequences there are."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    groups = max(1, docs.count() // NUMBERED)
    tokens = S.keyed(docs).mapInArrow(_token_rows(vocabulary), "id long, th long, doc_id long, m long, n long, ids binary")
    # Groups of ids are numbered each in its order; the ids are shuffled once for that, and the records once to their shards.
    pieces = F.col("m") * F.ceil(F.col("n") / length)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = tokens.withColumn("g", F.pmod(F.xxhash64("id", "th"), F.lit(groups)).cast("int"))
    numbered = materialize(grouped.withColumn("inner", before(pieces, W.partitionBy("g").orderBy("id", "th", "n", "m"))).select("g", "doc_id", "m", "n", "inner", "ids"))
    totals = materialize(numbered.groupBy("g").agg(F.sum(pieces).alias("sequences")))
    outer = totals.select("g", before("sequences", W.partitionBy(F.lit(0)).orderBy("g")).alias("outer"))  # a row for NUMBERED documents
    count = int(totals.agg(F.sum("sequences")).collect()[0][0] or 0)
    placed = numbered.join(F.broadcast(outer) if groups <= FEW else outer, "g")
    return numbered, placed.select("doc_id", "m", "n", (F.col("inner") + F.col("outer")).alias("start"), "ids"), count


def _ordered(placed: DataFrame, count: int, key: int, length: int, per_shard: int, low: int, high: int) -> DataFrame:
    """The records of shards ``low`` to ``high`` - 1; a partition holds its shards in slot order."""
    records = placed.mapInArrow(_record_rows(count, key, length, per_shard, low * per_shard, high * per_shard), RECORD)
    each = max(1, min(SHARDS, (high - low) // (4 * placed.sparkSession.sparkContext.defaultParallelism)))
    return records.repartitionById(max(1, -(-(high - low) // each)), F.floor((F.col("shard") - low) / each).cast("int")).sortWithinPartitions("slot")


def training_order(docs: DataFrame, tokenizer: str = TOKENIZER, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq, n_tokens, record; a partition holds its shards in slot order.

    A record is its number of tokens (four bytes), the ids, and zeros up to the stride, little-endian.
    """
    _, placed, count = _numbered(docs, tokenizer, length)
    return _ordered(placed, count, key, length, per_shard, 0, -(-count // per_shard))


def written(ordered: DataFrame, folder: str) -> DataFrame:
    """Write each shard of ``training_order`` as a file of bare records; its rows, with path and sha256 of their file for the record.

    A task writes under a name of its own and renames, so a repeated or a second attempt leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        own = f"{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}"
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        now, held = None, []

        def close():
            path, digest = f"{base}/shard-{now:06d}.bin", hashlib.sha256()
            with where.open_output_stream(f"{path}.{own}") as out:
                for batch in held:
                    raw = b"".join(batch.column(6).to_pylist())
                    out.write(raw)
                    digest.update(raw)
            where.move(f"{path}.{own}", path)
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([path] * len(batch)), pa.array([digest.hexdigest()] * len(batch))], names=[*batch.schema.names[:6], "path", "sha256"])

        for batch in batches:
            shard = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if now is not None and shard[a] != now:
                        yield from close()
                        held = []
                    now = int(shard[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return ordered.mapInArrow(run, INDEX + ", path string, sha256 string")


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """The manifest of ``written``: shard, path, n, sha256; one row for each file; empty for an empty table."""
    return written(ordered, folder).groupBy("shard").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.first("sha256").alias("sha256"))


def with_records(index: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Add ``record`` to the rows of ``written``, read from the files: neighbours in a file by one read."""
    names = [f.name for f in index.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        path, file = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                begin, paths, records = batch.column(2).to_pylist(), batch.column(6).to_pylist(), []
                stride = 4 + length * 2
                i = 0
                while i < len(begin):
                    j = i + 1
                    while j < len(begin) and paths[j] == paths[i] and begin[j] == begin[j - 1] + stride:
                        j += 1
                    if paths[i] != path:
                        path, file = paths[i], where.open_input_file(paths[i])
                    raw = file.read_at((j - i) * stride, begin[i])
                    records += [raw[k : k + stride] for k in range(0, len(raw), stride)]
                    i = j
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(records, pa.binary())], names=[*names, "record"])

    return index.mapInArrow(run, INDEX + ", path string, sha256 string, record binary")


def token_shards(docs: DataFrame, tokenizer: str = TOKENIZER, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write all shards to the shared folder, where they stay until the process ends; their rows, records read from the files.

    Ranges of shards are written one after another, which takes a part of the shuffle's disk at a time.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tidemark-shards-{uuid.uuid4().hex}"
    forget_at_exit(spark, folder)
    numbered, placed, count = _numbered(docs, tokenizer, length)
    shards = -(-count // per_shard)
    cuts = sorted({shards * i // ROUNDS for i in range(ROUNDS + 1)})
    empty = spark.createDataFrame([], INDEX + ", path string, sha256 string")
    done = [materialize(written(_ordered(placed, count, key, length, per_shard, a, b), folder)) for a, b in zip(cuts, cuts[1:], strict=False)]
    discard(numbered)
    index = done[0] if done else empty
    for more in done[1:]:
        index = index.unionByName(more)
    return with_records(index, folder, length)


def read_sequences(path: str, first: int, count: int, length: int = LENGTH, width: int = 2) -> list[np.ndarray]:
    """Ids of ``count`` records of a shard file (a path or URI) from record ``first`` on: one seek, one read; none beyond its end."""
    from pyarrow import fs

    stride = 4 + length * width
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        size = f.size()
        raw = f.read_at(max(0, min(count * stride, size - first * stride)), min(first * stride, size))
    cut = [raw[i : i + stride] for i in range(0, len(raw), stride)]
    return [np.frombuffer(r, np.uint16 if width == 2 else np.uint32, int.from_bytes(r[:4], "little"), 4) for r in cut]
