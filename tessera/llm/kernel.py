"""Words and their hashes of a whole batch of texts at once, in numpy over the Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is still taken whole.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_CHAR = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_CHAR_LOW = _CHAR.copy()
_CHAR_LOW[65:91] = _CHAR[97:123]
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def give_back() -> None:
    """To the system, what was freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run over a task's batches, and then what it has freed is given back: workers wait for their next task as long as the
    executor lives, and would hold it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1) mod 2**64, kept up to the size of a chunk."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        m = max(n, CHUNK + 1)
        x = np.full(m, base, np.uint64)
        x[0] = 1
        have = np.cumprod(x, dtype=np.uint64)
        if m <= 2 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offset of each text with the end last. A null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes: first and last (exclusive)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the number of its first word (the total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of A-Z in lower case."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((_CHAR_LOW if lower else _CHAR)[data] * powers(_R, n), out=h[1:])
    x = (h[ends] - h[starts]) * powers(_R_INV, n)[starts]
    return mix(x + (ends - starts).astype(np.uint64))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a batch: first row, last row, bytes, offsets."""
    data, off = raw(batch.column(name))
    for i, j in pieces(off):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
