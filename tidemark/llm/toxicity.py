"""Toxic spans by a linear-chain conditional random field.

Labels mark documents; the token labels to learn from are derived from them: a token is
labelled toxic in a toxic document if its word, or a prefix of it, occurs in enough
labelled documents and in hardly any but toxic ones. The field has two states; a
token's evidence sums hashed weights of its word and of its prefixes and last bytes, and
transition scores link neighbours along the whole document. Forward-backward marginals of
tokens and of neighbouring pairs give the gradient of the conditional likelihood; a long
chain is worked on in blocks that hand their messages over. A document's score is a logistic of its
largest marginal log odds and of the expected number of toxic tokens, fitted on the
same labelled sample; tokens above one half are returned as byte spans.

Training reads about ``SAMPLE`` labelled documents, whole. A hash of the text deals them to ``SHARDS``
shards, each of which is learnt from in order of that hash; after each pass the weights are mixed. So
neither the rows' order nor their partitions change a score.

Defined results: null and empty texts score as texts without toxic evidence; a very long text is one chain; without
labelled rows of both kinds every score is 0; repeated rows get equal scores, and in the sample count each; ties
between equal texts don't matter; an empty table gives no rows; further columns do no harm, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.labelled import training_rows
from tidemark.llm.language_id import held_out
from tidemark.llm.store import materialize

#: Bits of a feature's index; tokens of a block of a chain.
BITS, RUN = 19, 64
#: Entries of one slice of a table or of the weights.
SLICE = 1 << 14
#: Labelled documents to learn from, at most about this many.
SAMPLE = 16_000
PREFIXES = (3, 4, 5, 6)
#: Parts of the sample that are learnt from side by side, passes over it, and documents and tokens of one step.
SHARDS, PASSES, STEP_DOCS, STEP_TOKENS = 8, 4, 64, 1 << 16


def evidence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, index): index (tokens, features) of the word, its prefixes and its last three bytes."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, offsets, punctuation=True)
    sums = K.prefix(low)
    top = np.uint64(64 - BITS)
    spans = [(starts, ends, 0)] + [(starts, np.minimum(starts + k, ends), k) for k in PREFIXES] + [(np.maximum(starts, ends - 3), ends, 7)]
    index = np.stack([K.mix(K.span_hash(sums, a, b) + np.uint64(salt * 0x51ED27)) >> top for a, b, salt in spans], axis=1)
    return starts, ends, first, index.astype(np.int32)


def _blocks(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, first): the blocks of each chain; those of chain i are first[i] to first[i + 1]."""
    pieces = (size + RUN - 1) // RUN
    nth = K.take_ranges(np.zeros(len(size), np.int64), pieces)
    begin = np.repeat(start, pieces) + RUN * nth
    return begin, np.minimum(np.repeat(start + size, pieces) - begin, RUN), np.concatenate(([0], np.cumsum(pieces)))


def _handed(product: np.ndarray, first: np.ndarray, forward: bool) -> np.ndarray:
    """The ratio of messages that enters each block, from the products of the blocks before (or after) it in its chain."""
    out = np.zeros(len(product)) if forward else np.ones(len(product))
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    at, count = (first[:-1] if forward else first[1:] - 1)[order], count[order]
    now = out[at[count > 0]].copy()
    for step in range(1, int(count.max(initial=0))):
        m = int(np.searchsorted(-count, -step, "left"))  # chains with more than ``step`` blocks
        done = at[:m] + (step - 1 if forward else 1 - step)
        p, r = product[done], now[:m]
        now = (p[:, 0, 1] + r * p[:, 1, 1]) / (p[:, 0, 0] + r * p[:, 1, 0]) if forward else (p[:, 1, 0] + p[:, 1, 1] * r) / (p[:, 0, 0] + p[:, 0, 1] * r)
        now = np.clip(now, 1e-15, 1e15)
        out[done + (1 if forward else -1)] = now
    return out


def messages(score: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence, forward, backward) ratios of the toxic state at each token of the chains.

    ``move[a, b]``: transition factor from state a to b. A chain enters from the clean state.
    """
    e = np.exp(np.clip(score, -30, 30))
    fore, back = np.empty(len(score)), np.empty(len(score))
    start, size, first = _blocks(start, size)
    if not len(start):
        return e, fore, back
    order = np.argsort(-size, kind="stable")
    begin, alive = start[order], np.searchsorted(-size[order], -np.arange(RUN), "left")  # blocks with more than t tokens
    longest = int(size.max())
    product = np.empty((len(start), 2, 2))
    if (np.diff(first) > 1).any():
        whole = np.tile(np.eye(2), (len(start), 1, 1))
        for t in range(longest):
            m = alive[t]
            step = whole[:m] @ move
            step[:, :, 1] *= e[begin[:m] + t][:, None]
            whole[:m] = step / step.max(axis=(1, 2), keepdims=True)
        product[order] = whole
    enter, leave = _handed(product, first, True)[order], _handed(product, first, False)[order]
    for t in range(longest):
        m = alive[t]
        at, r = begin[:m] + t, enter[:m]
        enter[:m] = np.clip(e[at] * (move[0, 1] + r * move[1, 1]) / (move[0, 0] + r * move[1, 0]), 1e-15, 1e15)
        fore[at] = enter[:m]
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        back[at] = leave[:m]
        r = np.clip(e[at] * leave[:m], 1e-15, 1e15)
        leave[:m] = (move[1, 0] + move[1, 1] * r) / (move[0, 0] + move[0, 1] * r)
    return e, fore, back


def marginals(score: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state at each token."""
    _, fore, back = messages(score, start, size, move)
    return np.log(fore) + np.log(back)


def gradient(score: np.ndarray, tags: np.ndarray, start: np.ndarray, size: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood: by each token's score, and by the scores of clean to toxic and toxic to toxic."""
    move = _move(transition)
    e, fore, back = messages(score, start, size, move)
    p = fore * back / (1 + fore * back)
    before, held = np.zeros(len(score)), np.zeros(len(score))  # the forward ratio and the tag of the token before
    inner = np.ones(len(score), bool)
    inner[start[size > 0]] = False
    at = np.flatnonzero(inner)
    before[at], held[at] = fore[at - 1], tags[at - 1]
    # An edge's marginal: forward, transition, evidence and backward, over their sum for all four pairs of states.
    on = e * back
    f01, f11 = move[0, 1] * on, before * move[1, 1] * on
    total = move[0, 0] + before * move[1, 0] + f01 + f11
    return p - tags, np.array([(f01 / total - (1 - held) * tags).sum(), (f11 / total - held * tags).sum()])


def _move(transition: np.ndarray) -> np.ndarray:
    return np.exp(np.array([[0.0, transition[0]], [0.0, transition[1]]]))


def _seen_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's documents: how many of either label hold each feature (word and prefixes)."""
    table = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        label = batch.column(batch.schema.get_field_index("label")).to_numpy() > 0
        for row, _, data, offsets in K.chunks(batch):
            _, _, first, index = evidence(data, offsets)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pairs = np.unique((doc[:, None] << BITS | index[:, :5]).ravel())
            kind = label[row + (pairs >> BITS)]
            for y in (0, 1):
                table[y] += np.bincount(pairs[kind == y] & (1 << BITS) - 1, minlength=1 << BITS)
    flat = table.ravel()
    parts = [flat[i : i + SLICE].astype(np.int32).tobytes() for i in range(0, len(flat), SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _learn_rows(marks, state) -> object:
    """One pass over each shard's documents, in their order, from the state that all start with: its change, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = marks.value
        learner, shard = None, None
        for batch in batches:
            own = batch.column(0).to_numpy()
            label = batch.column(batch.schema.get_field_index("label")).to_numpy() > 0
            for row, end, data, offsets in K.chunks(batch):
                _, _, first, index = evidence(data, offsets)
                tags = toxic[index[:, :5]].any(axis=1) & np.repeat(label[row:end], np.diff(first))
                for i in range(end - row):
                    if shard != own[row + i]:
                        if learner:
                            yield learner.change(shard)
                        learner, shard = Learner(*state.value), int(own[row + i])
                    learner.add(index[first[i] : first[i + 1]], tags[first[i] : first[i + 1]])
        if learner:
            yield learner.change(shard)

    return run


class Learner:
    """AdaGrad on the conditional log likelihood, a step for each ``STEP_DOCS`` documents or ``STEP_TOKENS`` tokens."""

    def __init__(self, w: np.ndarray, rest: np.ndarray, rate: float = 0.5, l2: float = 1e-5):
        self.base, self.base_rest, self.rate, self.l2 = w, rest, rate, l2
        self.w, self.rest = w.astype(np.float64), rest.copy()
        self.grown, self.grown_rest = np.full(len(w), 1e-3), np.full(3, 1e-3)
        self.index: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.tokens = 0

    def add(self, index: np.ndarray, tags: np.ndarray) -> None:
        if len(tags):
            self.index.append(index)
            self.tags.append(tags)
            self.tokens += len(tags)
        if len(self.tags) >= STEP_DOCS or self.tokens >= STEP_TOKENS:
            self.step()

    def step(self) -> None:
        if not self.tags:
            return
        size = np.array([len(t) for t in self.tags])
        x, y = np.concatenate(self.index), np.concatenate(self.tags).astype(float)
        g, g_move = gradient(self.w[x].sum(axis=1) + self.rest[2], y, np.cumsum(size) - size, size, self.rest[:2])
        g, g_rest = g / len(size), np.append(g_move, g.sum()) / len(size)
        by = np.bincount(x.ravel(), weights=np.repeat(g, x.shape[1]), minlength=len(self.w))
        hit = np.flatnonzero(by)
        self.grown[hit] += by[hit] ** 2
        self.w[hit] -= self.rate * (by[hit] / np.sqrt(self.grown[hit]) + self.l2 * self.w[hit])
        self.grown_rest += g_rest**2
        self.rest -= 0.2 * g_rest / np.sqrt(self.grown_rest)
        self.rest[:2] = np.clip(self.rest[:2], -3, 3)
        self.index, self.tags, self.tokens = [], [], 0

    def change(self, shard: int) -> pa.RecordBatch:
        self.step()
        delta = (self.w - self.base).astype(np.float32)
        parts = [delta[i : i + SLICE].tobytes() for i in range(0, len(delta), SLICE)] + [(self.rest - self.base_rest).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["part", "shard", "delta"])


def _mix_rows(table: pa.Table) -> pa.Table:
    """The mean change of each weight over the shards that changed it, added up in the order of the shards."""
    part = table.column("part")[0].as_py()
    kind = np.float32 if part < (1 << BITS) // SLICE else np.float64
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("delta").to_pylist(), strict=True))
    total = np.zeros(len(rows[0][1]) // np.dtype(kind).itemsize)
    touched = np.zeros(len(total))
    for _, raw in rows:
        total += np.frombuffer(raw, kind)
        touched += np.frombuffer(raw, kind) != 0
    return pa.table({"part": pa.array([part], pa.int32()), "delta": pa.array([(total / np.maximum(touched, 1)).tobytes()], pa.binary())})


def _fit(spark: SparkSession, rows: DataFrame, marks) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and the scores of both transitions and the bias, after ``PASSES`` passes."""
    dealt = rows.select(F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64(F.lit(1), "text").alias("place"), "text", "label")
    w, rest = np.zeros(1 << BITS, np.float32), np.array([0.0, 0.0, -4.0])
    for _ in range(PASSES):
        state = spark.sparkContext.broadcast((w, rest))
        ordered = dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "label")
        changes = ordered.mapInArrow(_learn_rows(marks, state), "part int, shard int, delta binary")
        got = {r.part: np.frombuffer(bytes(r.delta)) for r in changes.groupBy("part").applyInArrow(_mix_rows, "part int, delta binary").collect()}
        last = max(got)
        w = (w + np.concatenate([got[i] for i in range(last)])).astype(np.float32)
        rest = rest + got[last]
    return w, rest


def _tag(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, rest: np.ndarray):
    """Token bounds and log odds; for each row the largest log odds and the log of one plus the expected toxic tokens."""
    starts, ends, first, index = evidence(data, offsets)
    u = np.full(len(starts), rest[2])
    for j in range(index.shape[1]):
        u += w[index[:, j]]
    odds = marginals(u, first[:-1], np.diff(first), _move(rest[:2]))
    rows = np.flatnonzero(np.diff(first))
    top, many = np.full(len(first) - 1, -12.0), np.zeros(len(first) - 1)
    if len(rows):
        p = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
        top[rows] = np.clip(np.maximum.reduceat(odds, first[rows]), -12, 12)
        many[rows] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), first[rows]))
    return starts, ends, first, odds, np.stack((top, many), axis=1)


def _stat_rows(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rest = model.value
        for batch in batches:
            for row, end, data, offsets in K.chunks(batch):
                *_, stats = _tag(data, offsets, w, rest)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), pa.array(stats[:, 0]), pa.array(stats[:, 1])], names=["label", "top", "many"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b))
        b -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 0.01 * b), -2, 2)
    return b


def _score_rows(model, scale: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rest = model.value
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            scores, sizes, begin, stop = [np.empty(0)], [np.zeros(0, np.int64)], [], []
            for _, _, data, offsets in K.chunks(batch):
                starts, ends, first, odds, stats = _tag(data, offsets, w, rest)
                scores.append(1 / (1 + np.exp(-np.clip(scale[0] + stats @ scale[1:], -35, 35))))
                hot = np.flatnonzero(odds > 0)
                doc = np.searchsorted(first, hot, "right") - 1
                apart = np.ones(len(hot), bool)
                apart[1:] = (np.diff(hot) != 1) | (np.diff(doc) != 0)
                a = np.flatnonzero(apart)
                b = np.append(a[1:], len(hot))[: len(a)] - 1
                sizes.append(np.bincount(doc[a], minlength=len(first) - 1))
                begin.append(starts[hot[a]] - offsets[doc[a]])
                stop.append(ends[hot[b]] - offsets[doc[a]])
            score = np.concatenate(scores)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32))
            bounds = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32))
            spans = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([cat(begin), cat(stop)], fields=list(kind.value_type)))
            cols = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), spans]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (byte ranges); learns where crc32(doc_id as text) mod 5 is not 0."""
    spark = docs.sparkSession
    rows = materialize(training_rows(docs, labels, "toxic", 5, 0, SAMPLE))  # read three times
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(_seen_rows, "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
    flat = np.concatenate([np.frombuffer(bytes(r.counts), np.int64) for r in sorted(got, key=lambda r: r.part)]) if got else np.zeros(2 << BITS, np.int64)
    clean, toxic = flat.reshape(2, -1)
    # The share's lower bound must pass 0.8: few occurrences need to be toxic all, many nearly all.
    n = np.maximum(clean + toxic, 1)
    sure = toxic / n - np.sqrt((toxic / n) * (clean / n) / n) - 0.6 / n
    marks = spark.sparkContext.broadcast((sure > 0.8) & (toxic >= 4))
    if not marks.value.any():
        return text.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<struct<begin:int,stop:int>>").alias("spans"))
    shared = spark.sparkContext.broadcast(_fit(spark, rows, marks))
    known = rows.mapInArrow(_stat_rows(shared), "label int, top double, many double").toPandas()  # SAMPLE rows of three numbers
    known = known.sort_values(["label", "top", "many"])  # sums in one order
    scale = _logistic(known[["top", "many"]].to_numpy(), (known["label"] > 0).to_numpy(float))
    return text.mapInArrow(_score_rows(shared, scale), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:int,stop:int>>")
