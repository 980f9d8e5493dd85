"""Text columns as byte buffers: what the Python tasks of this package share.

A batch of texts is one UTF-8 buffer with the offsets of its documents, so words,
hashes and windows of all its documents come from a few array operations. Batches are
cut into pieces of a few megabytes; one document is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
PIECES_HELD = 64  # results between two returns of freed memory

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.isin(np.arange(256), _SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch after about ``most`` bytes of ``column``; a row is never cut."""
    sizes = np.diff(offsets_of(batch.column(column)))
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def returned(results: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``results``, giving memory that is free again back to the system now and then and at the end.

    A Python worker serves many tasks of all stages; what Arrow's pool and the allocator keep for
    themselves after one of them would stay beside the next one's needs.
    """

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    try:
        for i, result in enumerate(results, 1):
            yield result
            if i % PIECES_HELD == 0:
                del result
                give_back()
    finally:
        give_back()


def _filled(array: pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    return array.fill_null(b"") if array.null_count else array


def offsets_of(array: pa.Array) -> np.ndarray:
    array = _filled(array)
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more than texts). Null is empty."""
    array = _filled(array)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of one buffer as an Arrow column."""
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


def words_of(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes outside ``separator``, and the words before each document.

    Words don't run over document ends.
    """
    inside = ~separator
    starts = inside.copy()
    starts[1:] &= separator[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= separator[1:]
    last = first if len(first) == 0 else offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte values, by differences of prefix sums."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    powers = np.full(len(data), _ODD, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers, out=prefix[1:])
    back = np.full(len(data), _ODD_INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((prefix[end] - prefix[begin]) * back[begin] + (end - begin).astype(np.uint64))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` tokens in a row (over document ends too; the caller leaves those out)."""
    n = max(0, len(tokens) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total + tokens[k : k + n])
    return total
