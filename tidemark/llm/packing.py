"""Best-fit packing of documents into sequences, certified by lower bounds.

Each text is encoded once; its ids and an end mark are cut into pieces only where they exceed
a sequence. Pieces are dealt over partitions by a hash, and each partition packs its own by
best fit in decreasing length. Dual-feasible functions of the lengths give a count of sequences
that no packing can go below; a partition that meets its bound is certified. Partitions are then
looked at in groups of ``FAN``: where their sequences together exceed the bound of their
lengths together, the group has a gap, and its partitions exchange documents: each hands over the
pieces of its loosest sequences, which meet in one partition and are packed anew. The new packing is kept where it
saves a sequence, the old one where it doesn't. Groups of groups follow, until all are certified or one is left.
The number of pieces that a partition holds in any round is bounded by ``PART`` (but for the spread of the hash).

Defined results: null and empty texts are one piece with the end mark alone; a very long text is cut into many pieces,
dealt like all others; equal rows are packed each; ties go by row and piece; a null doc_id
stays null; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoders import Remembered, byte_letters, id_type, public_path, word_chunks
from tidemark.llm.skew import FEW, matching
from tidemark.llm.store import materialize

TOKENIZER, LENGTH, END = "word_bpe_49k.json", 2048, 0
#: Pieces that one partition packs, the fewest it gets, and partitions that exchange documents.
PART, LEAST, FAN = 131_072, 512, 8
#: Chunks that a task remembers at most.
KNOWN = 600_000
#: Dual-feasible functions of the rounding family that are tried.
ROUNDINGS = 64


#: A word of letters that ends in an ASCII one, then a little ASCII punctuation: bytes of the letters up to U+00FF but for the two signs among them.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*[A-Za-z])([!-&(-/:-@\[-`{-~]{0,3})")
_WORD_END = "</w>"


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space; no token crosses it, so chunks between white space are remembered.

    Most new chunks are a word and perhaps punctuation behind it, between which the vocabulary always cuts. Its tokens are numbered in
    the order of their merges, so a word is merged by ranks; as text is lower case there, a capital stands for a
    word's last letter. Whatever else there is goes to the tokenizer itself.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.end, self.known = np.array([end], self.kind).tobytes(), Remembered(self.ids, KNOWN)
        letters, ranks, self.last = byte_letters(), {}, np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token, i in vocabulary.items():
            last = token.endswith(_WORD_END) and len(token) > len(_WORD_END)
            raw = bytes(letters[c] for c in (token[: -len(_WORD_END)] if last else token))
            if last and not 97 <= raw[-1] <= 122 or not last and any(65 <= x <= 90 for x in raw):
                continue
            ranks[raw[:-1] + bytes([raw[-1] - 32]) if last else raw] = i
            self.last[i] = last
        self.words = tiktoken.Encoding("own", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tails: dict[bytes, bytes] = {b"": b""}

    def chunks(self, text: bytes) -> list[bytes]:
        """Chunks in lower case where that changes no id: no special token, nor a mark that composes with a letter."""
        return word_chunks(text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower())

    def hard(self, chunks: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, all merged at once; tokens that end a word say where the next one's begin."""
        raw = np.frombuffer(b" ".join(words).decode().lower().encode(), np.uint8).copy()
        raw[np.append(np.flatnonzero(raw == 32) - 1, len(raw) - 1)] -= 32
        ids = np.array(self.words(raw.tobytes().decode()))
        cuts = ((np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize).tolist()
        packed = ids.astype(self.kind).tobytes()
        return [packed[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        matched = [_PLAIN.fullmatch(c) for c in chunks]
        rest = iter(self.hard([c for c, m in zip(chunks, matched, strict=True) if not m]))
        own = [m for m in matched if m]
        words = iter(self.plain([m[1] for m in own]) if own else ())
        tails = list({m[2] for m in own}.difference(self.tails))
        self.tails.update(zip(tails, self.hard(tails), strict=True))
        return [next(words) + self.tails[m[2]] if m else next(rest) for m in matched]

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text and the end mark, as bytes."""
        cut = [self.chunks(t or b"") for t in texts]
        chunks = list(chain.from_iterable(cut))
        found = list(map(self.known.get, chunks))
        unknown = [i for i, x in enumerate(found) if x is None]
        if unknown:
            new = self.known.learn({chunks[i] for i in unknown})
            for i in unknown:
                found[i] = new[chunks[i]]
        stop = 0
        for own in cut:
            start, stop = stop, stop + len(own)
            yield b"".join(found[start:stop]) + self.end


_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _encoded(path: str, length: int, end: int) -> object:
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, row = WordEncoder(path, end), TaskContext.get().partitionId() << 40
        width = encode.kind.itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    for piece, start in enumerate(range(0, len(ids), length * width)):
                        own = ids[start : start + length * width]
                        wide = np.frombuffer(own, encode.kind).astype("<u4").tobytes()
                        out.append((row, doc_id, piece, start // width, len(own) // width, zlib.crc32(wide), own))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32, ids (little-endian, two bytes each where the vocabulary allows it), written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(_encoded(path or public_path(TOKENIZER), length, end), _PIECES))


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that pieces with ``counts`` by length need at least; the last length is a whole sequence.

    Two families of dual-feasible functions. One drops pieces below k and counts those above
    length - k as whole. The other rounds (k + 1) x down to whole sequences, but for exact multiples,
    which it leaves as they are. The sum of lengths is their common start.
    """
    full = len(counts) - 1
    x = np.arange(full + 1, dtype=np.int64)
    mass = counts * x
    best = -(-int(mass.sum()) // full)
    if full > 1:
        k = np.arange(1, full // 2 + 1)
        many, sums = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(mass)))
        large, middle = many[-1] - many[full - k + 1], sums[full - k + 1] - sums[k]
        best = max(best, int((large + -(-middle // full)).max()))
    for k in range(1, min(ROUNDINGS, full) + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % full == 0, k * x, scaled // full * full)
        best = max(best, -(-int((counts * value).sum()) // (k * full)))
    return best


def best_fit(lengths: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, room of the bin) of each piece; ``lengths`` fall. A piece goes where the least room is left behind it.

    Bins are kept by their room, and one whole number has a bit for each room that some bin has,
    so the tightest fit is its lowest bit from the piece's length on.
    """
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(full + 1)]
    rooms: list[int] = []
    there = 0
    for i, x in enumerate(lengths.tolist()):
        fits = there >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            now = by_room[room].pop()
            if not by_room[room]:
                there ^= 1 << room
        else:
            room, now = full, len(rooms)
            rooms.append(full)
        bins[i], offset[i] = now, full - room
        room -= x
        rooms[now] = room
        if room:
            by_room[room].append(now)
            there |= 1 << room
    return bins, offset, np.array(rooms, np.int64)[bins] if rooms else bins


_PLACED = "row long, piece int, length long, part int, sequence_id long, offset long, room long, saved long"


def _packed(full: int, turn: int) -> object:
    """Pack what a partition holds; what was packed before stays so unless the new packing has fewer sequences."""
    names = [f.split()[0] for f in _PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = {c: table.column(c).to_numpy() for c in table.schema.names}
        for part in np.unique(col["part"]):
            at = np.flatnonzero(col["part"] == part)
            at = at[np.lexsort((col["piece"][at], col["row"][at], -col["length"][at]))]
            bins, offset, room = best_fit(col["length"][at], full)
            sequence, saved = (np.int64(turn) << 58) + (np.int64(part) << 28) + bins, 0
            if turn:
                before = len(np.unique(col["sequence_id"][at]))
                saved = before - len(np.unique(bins))
                if saved <= 0:
                    sequence, offset, room, saved = col["sequence_id"][at], col["offset"][at], col["room"][at], 0
            gain = np.zeros(len(at), np.int64)
            gain[:1] = saved
            own = [col["row"][at], col["piece"][at], col["length"][at], col["part"][at], sequence, offset, room, gain]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=names)

    return run


def _loosest(most: int, full: int) -> object:
    """Mark the pieces of each partition's loosest sequences, up to ``most`` pieces; a piece that fills a sequence never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one batch of _packed is one partition's pieces
            col = {c: batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
            order = np.lexsort((col["sequence_id"], -col["room"]))
            loose = np.zeros(len(order), bool)
            loose[order[:most]] = True
            loose &= col["length"] < full
            # A sequence is loose as a whole or not at all.
            ids, place = np.unique(col["sequence_id"], return_inverse=True)
            tight = np.zeros(len(ids), bool)
            tight[place[~loose]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~tight[place])], names=[*batch.schema.names, "loose"])

    return run


def _bounds(full: int) -> object:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros(full + 1, np.int64)
        np.add.at(counts, table.column("length").to_numpy(), table.column("n").to_numpy())
        sequences, counts[0] = int(counts[0]), 0
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sequences": pa.array([sequences], pa.int64()), "bound": pa.array([lower_bound(counts)], pa.int64())})

    return run


def bounds(placed: DataFrame, full: int = LENGTH) -> DataFrame:
    """(part, sequences, bound) of each partition of placed pieces."""
    return _with_bounds(_by_length(placed), full)


def _by_length(placed: DataFrame) -> DataFrame:
    """(part, length, n): pieces by length; length 0 has the number of sequences."""
    counted = placed.groupBy("part", "length").agg(F.count("*").alias("n"))
    bins = placed.groupBy("part").agg(F.count_distinct("sequence_id").alias("n")).select("part", F.lit(0).cast("long").alias("length"), "n")
    return counted.unionByName(bins)


def _with_bounds(by_length: DataFrame, full: int) -> DataFrame:
    return by_length.groupBy("part").applyInArrow(_bounds(full), "part int, sequences long, bound long")


def place(lengths: DataFrame, full: int = LENGTH, part: int = PART) -> DataFrame:
    """row, piece, sequence_id, offset for each row, piece, length of a written table."""
    spark = lengths.sparkSession
    total = lengths.count()
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-total // part), min(dealt, -(-total // LEAST)), 1)
    keyed = lengths.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).cast("int").alias("part"))
    now = materialize(keyed.repartitionById(parts, "part").mapInArrow(_packed(full, 0), _PLACED).mapInArrow(_loosest(part // FAN, full), _PLACED + ", loose boolean"))
    settled, stats, turn = [], materialize(_by_length(now)), 0
    group = F.floor(F.col("part") / FAN).cast("int")
    while parts > 1:
        turn, parts = turn + 1, -(-parts // FAN)
        stats = materialize(stats.groupBy(group.alias("part"), "length").agg(F.sum("n").alias("n")))
        gaps = materialize(_with_bounds(stats, full).where("sequences > bound").select("part"))
        now = now.withColumn("part", group)
        if gaps.isEmpty():  # all certified: larger groups may still have a gap
            continue
        moving = now.where("loose")
        pool = materialize(matching(moving, gaps, "part").drop("loose", "saved"))
        settled.append(now.where(~F.col("loose")))
        settled.append(matching(moving, gaps, "part", "left_anti"))
        packed = pool.repartitionById(parts, "part").mapInArrow(_packed(full, turn), _PLACED)
        now = materialize(packed.mapInArrow(_loosest(part // FAN, full), _PLACED + ", loose boolean"))
        less = now.groupBy("part").agg((-F.sum("saved")).alias("n")).select("part", F.lit(0).cast("long").alias("length"), "n")
        stats = stats.unionByName(less)
    out = now
    for rows in settled:
        out = out.unionByName(rows.select(now.columns))
    return out.select("row", "piece", "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, part: int = PART) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset for every piece.

    Nothing reads the ids again unless they are selected.
    """
    cut = pieces(docs, path, length, end)
    return cut.join(place(cut.select("row", "piece", "length"), length, part), ["row", "piece"]).drop("row")


def certificate(packed: DataFrame, full: int = LENGTH) -> DataFrame:
    """(part, sequences, bound): one row for the whole packing of ``pack``."""
    return bounds(packed.withColumn("part", F.lit(0)), full)
