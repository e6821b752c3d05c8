"""Numpy views of Arrow text columns: blocks bounded by bytes, words by their bytes, and 64-bit hashes of words.

A word is a run of bytes that are not ASCII white space, so multi-byte
characters never split. Words of all rows of a block are found and hashed at
once; a very long text goes in segments that end at white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
SEGMENT = 1 << 20
BLOCK_BYTES = 1 << 19
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER_KEYS = _BYTE_KEYS.copy()
_LOWER_KEYS[65:91] = _BYTE_KEYS[97:123]
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
STEP_KEYS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def release_memory() -> None:
    """Gives freed memory back to the system, which allocators keep otherwise: a worker waits for its next task with as little as it can."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 65536), base, U64)
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one array with 64-bit offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, from 0) and bytes of a large_string array, without a copy."""
    n, at = len(column), column.offset
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with about ``limit`` bytes of text each (one longer text is a slice of its own)."""
    column = texts(batch.column(batch.schema.get_field_index(text)))
    offsets, _ = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a), column.slice(a, b - a)
        a = b


def segments(offsets: np.ndarray, data: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that end at white space or between two rows."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + limit)
        while b < n:
            window = data[b : b + 4096]
            space = np.flatnonzero(IS_SPACE[window])
            row = int(np.searchsorted(offsets, b))
            edge = int(offsets[row]) if row < len(offsets) else n
            stop = min(b + int(space[0]) if len(space) else n, edge)
            if stop <= b + len(window):
                b = stop
                break
            b += len(window)
        yield a, min(b, n)
        a = min(b, n)


def spans(offsets: np.ndarray, data: np.ndarray, a: int, b: int, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, from ``a``, of the words in data[a:b]; with ``kinds`` (a class per byte, 0: none), of runs of one class."""
    part = data[a:b]
    kind = (part != 32) & (part - np.uint8(9) > 4) if kinds is None else kinds[part]  # the latter: IS_SPACE without a lookup
    change = np.empty(b - a + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    inner = offsets[(offsets > a) & (offsets < b)] - a
    change[inner] = True
    edges = np.flatnonzero(change)
    keep = kind[edges[:-1]] > 0
    return edges[:-1][keep], edges[1:][keep]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    sums = np.zeros(len(data) + 1, U64)
    keys = (_LOWER_KEYS if lower else _BYTE_KEYS)[data]
    keys *= _power("up", _BASE, len(data))
    np.cumsum(keys, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def word_hashes(column: pa.Array, lower: bool = True, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows in order, and the number of words before each row (rows + 1)."""
    offsets, data = buffers(column)
    found, before = [], np.zeros(len(offsets), np.int64)
    for a, b in segments(offsets, data):
        starts, ends = spans(offsets, data, a, b, kinds)
        found.append(hash_spans(data[a:b], starts, ends, lower))
        before += np.searchsorted(starts, offsets - a)
    return np.concatenate(found) if found else np.zeros(0, U64), before


def by_row(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Places that bring values together by row and keep their order within it."""
    return np.argsort(rows.astype(np.uint16) if n_rows <= 1 << 16 else rows, kind="stable")


def shingle_table(column: pa.Array, k: int = 5, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets of k-word shingles, A-Z lower-cased: offsets (rows + 1), and each row's distinct hashes in rising order.

    A row of fewer than k words has its whole sequence as one shingle; one of
    fewer than ``least`` words has none.
    """
    words, first = word_hashes(column)
    n, counts = len(column), np.diff(first)
    hashes, rows = [], []
    for width in range(1, k + 1):
        # the shingles of this width in each row: all, or one of the whole row
        many = np.where(counts >= max(k, least), counts - k + 1, 0) if width == k else ((counts == width) & (counts >= least)).astype(np.int64)
        total = int(many.sum())
        if not total:
            continue
        start = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
        # where few words start a shingle of this width, only these are looked at
        few = total * 4 < len(words)
        n_windows = total if few else len(words) - width + 1
        windows = np.full(n_windows, width, U64)
        for i in range(width):
            windows += (words[start + i] if few else words[i : n_windows + i]) * STEP_KEYS[i]
        hashes.append(mix(windows if few else windows[start]))
        rows.append(np.repeat(np.arange(n), many))
    if not hashes:
        return np.zeros(n + 1, np.int64), np.zeros(0, U64)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(hashes)
    order = order[by_row(rows[order], n)]
    hashes, rows = hashes[order], rows[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])
    return np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=n))]), hashes[new]
