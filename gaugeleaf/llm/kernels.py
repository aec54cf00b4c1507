"""Vectorised byte, word and hash kernels used inside Arrow map tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; bounds the temporary arrays.
SLICE_BYTES = 2 << 20

_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII character but letters and digits separates.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Runs of rows of at most limit bytes (one row at least): (first row, rows, bytes, offsets from 0)."""
    array = batch.column(batch.schema.get_field_index(column))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    n = len(array)
    if not n:
        return
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool = True):
    """Starts, ends and hashes of the words of texts laid end to end, and the first word of each text.

    Words never cross a text's end.  Equal words (after A-Z to a-z with fold) have equal hashes.
    """
    if fold:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    return starts, ends, hashes, first


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values, whatever text they are in."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[i : i + m]
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The text index of every word, from the first word of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, laid end to end."""
    total = int(counts.sum())
    begins = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begins, counts)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
