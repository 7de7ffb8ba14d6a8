"""Vectorised text kernels shared by the operators of this package.

Arrow hands a batch's strings over as one byte buffer with offsets. The kernels
work on slices of that buffer with NumPy, so no Python object is made for a
document or a word. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call works on (a longer document goes alone).
CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Base of a second hash, independent of the first.
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of about ``limit`` bytes."""
    yield from pieces(batch.column(batch.schema.get_field_index(text)), limit)


def pieces(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``chunks`` of one column."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(raw, raw[row] + limit, "right")) - 1)
        end = min(end, len(col))
        yield row, end, data[raw[row] : raw[end]], raw[row : end + 1] - raw[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words; those of row i are first[i] to first[i + 1].

    A word is a maximal run without ASCII white space, or with ``punctuation``
    also without other ASCII bytes that are no letters or digits.
    """
    n = len(data)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~(_PUNCT if punctuation else _SPACE)[data]
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    stops = inside[:-1] & (~inside[1:] | edge[1:])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def prefix(data: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Running polynomial sums, from which ``span_hash`` takes any range's hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes, wherever they are."""
    return mix((sums[ends] - sums[starts]) * _power(_inverse(base), len(sums))[starts])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at 0, 1, ... of the sequence behind ``sums``."""
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * _power(_inverse(_BASE), len(sums))[:n]) if n > 0 else np.empty(0, np.uint64)


def word_sums(hashes: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """``prefix`` for a sequence of word hashes."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    if len(hashes):
        np.cumsum(hashes * _power(base, len(hashes)), out=out[1:])
    return out


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i with a whole window."""
    have, out = 1, x.copy()
    while have < w:
        step = min(have, w - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(order: np.ndarray, w: int, offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions of k-grams that are least in some window of w k-grams of one row.

    ``order``: a rank by content for each k-gram; ``offsets``: rows' bounds in
    units. Windows of equal content mark the same places, and every window
    marks at least one, so two copies of a run of w + k - 1 units share a mark.
    """
    n = len(order)
    if n < w:
        return np.empty(0, np.int64)
    order = np.maximum(order, 1)  # zero stands for no window
    low = _slide(order, w, np.minimum)
    whole = np.zeros(len(low), bool)
    for a, b in _ranges(offsets, w + k - 1):
        whole[a:b] = True
    low[~whole] = 0
    padded = np.zeros(n + w - 1, order.dtype)
    padded[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero((_slide(padded, w, np.maximum) == order))


def _ranges(offsets: np.ndarray, span: int) -> Iterator[tuple[int, int]]:
    ends = offsets[1:] - span + 1
    for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True):
        if b > a:
            yield a, b


def take_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    at = np.concatenate(([0], np.cumsum(c)[:-1]))
    out[at] = s - np.concatenate(([0], s[:-1] + c[:-1] - 1))
    out[0] = s[0]
    return np.cumsum(out)
