"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become integers, floor(1024 x). Blocks of vectors are indexed: for each component
the rows are cut into posting segments by a quantised value, each with the bounds of
what it holds. A query visits segments by falling impact, its weight times the
segment's bound, and keeps for each vector a lower and an upper bound of the score so
far. What is unvisited can add no more than the next impact of each component. The
query stops only when few vectors can still reach the k-th best lower bound;
those are all rescored exactly, so the result is exact, ties by the smaller id.

Query blocks meet index blocks by an equality join on block numbers; each pair
returns k rows for each query, and the best k of all are kept.

Defined results: vectors that are null or hold a null or non-finite component
take no part; shorter vectors count as padded with zeros, so an empty one scores 0 with every other; a very long vector widens its block alone; rows with
equal vec_id are candidates each, and a query is every row whose id is divisible, never paired with
its own row, so that twins find one another and each has its own ranks; null ids take no part; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.store import materialize

INDEX_ROWS, QUERY_ROWS, LEVELS, CANDIDATES = 4096, 4096, 16, 64


def _integers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers and integer rows of the vectors that take part, padded with zeros to one width."""
    lists = table.column("embedding").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    wide = np.zeros((len(size), max(1, int(size.max(initial=0)))))  # an empty vector is zero throughout
    wide[np.arange(wide.shape[1])[None, :] < size[:, None]] = values
    ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    ok = np.isfinite(wide).all(axis=1)
    return ids[ok], rows[ok], np.floor(wide[ok] * 1024).astype(np.int64)


def _block_rows(key: str) -> object:
    def run(table: pa.Table) -> pa.Table:
        ids, rows, x = _integers(table)
        order = np.argsort(rows, kind="stable")
        packed = {name: pa.array([a[order].tobytes()], pa.binary()) for name, a in (("ids", ids), ("rows", rows), ("x", x))}
        return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.int32()), **packed})

    return run


class Index:
    """Posting segments of one block of integer vectors."""

    def __init__(self, x: np.ndarray):
        n, width = x.shape
        rows, lows, highs, comps, cuts = [], [], [], [], [0]
        for d in range(width):
            order = np.argsort(x[:, d], kind="stable")
            v = x[order, d]
            step = max(1, int(v[-1] - v[0]) // LEVELS + 1)
            begin = np.flatnonzero(np.concatenate(([True], np.diff((v - v[0]) // step) != 0)))
            stop = np.append(begin[1:], n)
            rows.append(order)
            lows.append(v[begin])
            highs.append(v[stop - 1])
            comps.append(np.full(len(begin), d))
            cuts.extend((d * n + stop).tolist())
        self.x, self.rows = x, np.concatenate(rows)
        self.low, self.high, self.comp = (np.concatenate(a) for a in (lows, highs, comps))
        self.begin, self.stop = np.array(cuts[:-1]), np.array(cuts[1:])

    def search(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) that hold the k best of the rows not in ``skip``."""
        n, width = self.x.shape
        w = q[self.comp].astype(np.float64)
        top = np.where(w >= 0, w * self.high, w * self.low)
        low = np.where(w >= 0, w * self.low, w * self.high)
        # What rounding of the float sums can add up to at most.
        slack = np.abs(q).astype(float) @ np.abs(self.x).max(axis=0) * (4 * width * np.finfo(float).eps)
        order = np.lexsort((np.arange(len(top)), -top))
        sizes = self.stop[order] - self.begin[order]
        done = np.cumsum(sizes)
        upper, lower = np.zeros(n), np.zeros(n)
        worst = np.full(width, np.inf)
        np.minimum.at(worst, self.comp, low)
        left_low = np.full(n, worst.sum())  # of the components not yet seen, at the least
        at = 0
        while at < len(order):
            end = int(np.searchsorted(done, done[at - 1] + n * width // 8 if at else n * width // 2)) + 1
            seg = order[at:end]
            count = self.stop[seg] - self.begin[seg]
            offset = np.repeat(self.begin[seg] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            own = self.rows[offset]
            upper += np.bincount(own, weights=np.repeat(top[seg], count), minlength=n)
            lower += np.bincount(own, weights=np.repeat(low[seg] - worst[self.comp[seg]], count), minlength=n)
            at = end
            rest = order[at:]
            nxt = np.full(width, -np.inf)
            np.maximum.at(nxt, self.comp[rest], top[rest])
            bound = upper + np.maximum(nxt, 0).sum() + slack
            bound[skip] = -np.inf
            floor = lower + left_low
            floor[skip] = -np.inf
            threshold = np.partition(floor, n - k)[n - k] if n > k else -np.inf
            possible = np.flatnonzero(bound >= threshold - slack)
            if len(possible) <= CANDIDATES:
                break
        else:
            possible = possible if len(order) else np.arange(n)
        possible = possible[~np.isin(possible, skip)]
        return possible, self.x[possible] @ q


def _search_rows(k: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: tuple[int, Index, np.ndarray] | None = None
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                if not len(ids):
                    continue
                if built is None or built[0] != r["block"]:
                    built = (r["block"], Index(np.frombuffer(r["x"], np.int64).reshape(len(ids), -1)), ids)
                own = np.frombuffer(r["rows"], np.int64)
                qids, qrows = (np.frombuffer(r[c], np.int64) for c in ("qids", "qrows"))
                if not len(qids):
                    continue
                qs = np.frombuffer(r["qx"], np.int64).reshape(len(qids), -1)
                width = built[1].x.shape[1]
                qs = np.pad(qs, ((0, 0), (0, max(0, width - qs.shape[1]))))[:, :width]
                out = [[], [], [], []]
                for qid, qrow, q in zip(qids.tolist(), qrows.tolist(), qs, strict=True):
                    a, b = np.searchsorted(own, qrow, "left"), np.searchsorted(own, qrow, "right")
                    rows, score = built[1].search(q, k, np.arange(a, b))
                    best = np.lexsort((ids[rows], -score))[:k]
                    out[0].append(np.full(len(best), qid))
                    out[1].append(np.full(len(best), qrow))
                    out[2].append(ids[rows[best]])
                    out[3].append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides the k highest of all other rows."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    asked = base.where(F.col("vec_id") % every == 0)
    n, m = base.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).collect()[0]
    blocks, parts = max(1, -(-n // INDEX_ROWS)), max(1, -(-m // QUERY_ROWS))

    def deal(df: DataFrame, key: str, count: int) -> DataFrame:
        numbered = df.withColumn(key, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
        return numbered.groupBy(key).applyInArrow(_block_rows(key), f"{key} int, ids binary, rows binary, x binary")

    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    queries = deal(asked, "part", parts).select(each, F.col("ids").alias("qids"), F.col("rows").alias("qrows"), F.col("x").alias("qx"))
    # Merged, whatever the sizes seem: the copies of query blocks are made behind their shuffle, whose size would have them broadcast by
    # way of the driver. The one row of an index block is what the join holds.
    pairs = queries.join(deal(base, "block", blocks).hint("merge"), "block").select("block", "ids", "rows", "x", "qids", "qrows", "qx")
    found = pairs.mapInArrow(_search_rows(k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
