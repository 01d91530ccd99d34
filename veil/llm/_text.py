"""Vectorised handling of whole texts held in Arrow string columns.

A batch of texts is one byte buffer with offsets.  Words, 64-bit word keys and
everything derived from them come from array operations over that buffer, so no
Python object is made per word.

A span's key is a 64-bit sum over its eight-byte chunks, each put through a
multiply and xor-shift mix with a secret of its place, mixed once more with the
span's length.  The mix isn't linear, so no pattern of a text makes spans
collide as it can with polynomials; two of a million differing spans share a key
with a chance of 3e-8, whatever their bytes.  ``lane`` gives further keys for
names of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Odd secrets of the lanes.
_LANES = np.random.Generator(np.random.PCG64(20_240_917)).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), as a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(data: np.ndarray) -> np.ndarray:
    """For each place of data, and the one after its end, the next eight bytes as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_keys(eight: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Keys of the spans [start, end) of bytes given as ``chunks``; equal bytes have equal keys wherever they stand."""
    size, secret = end - start, _LANES[lane]
    total = mix((eight[start] & _LOW[np.minimum(size, 8)]) ^ secret)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        edge = np.cumsum(more)
        place = 1 + np.arange(edge[-1]) - np.repeat(edge - more, more)
        at = np.repeat(start[long], more) + 8 * place
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        total[long] += np.add.reduceat(mix((eight[at] & _LOW[left]) ^ mix(place.astype(np.uint64) * _PLACE + secret)), edge - more)
    return mix(total + size.astype(np.uint64) * _PLACE)


def batches(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most max_bytes, or of one longer text.  Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, pieces: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes without white space; runs never cross texts.

    pieces: spans that together hold every byte instead, cut before each white-space byte that stands between two others.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    if pieces:
        cut = first[:n].copy()
        cut[1:-1] |= space[1:-1] & ~space[:-2] & ~space[2:] & ~first[1 : n - 1] & ~first[2:n]
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
    else:
        begins = ~space
        begins[1:] &= space[:-1] | first[1:n]
        ends = ~space
        ends[:-1] &= space[1:] | first[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, text_of(start, offsets)


def text_of(position: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the text that holds each of the ascending positions."""
    at = np.searchsorted(position, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(at))


def sums(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by text number, as 64-bit integers."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(text, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]
