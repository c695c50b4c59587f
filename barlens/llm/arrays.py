"""Vectorised text work inside tasks: words, rolling hashes and anchors of whole Arrow batches.

Texts arrive as UTF-8 bytes of an Arrow column and are cut into chunks of a few
megabytes (a longer single text is a chunk of its own), so that the eight-byte
arrays made from the bytes stay bounded.  All hashes are 64-bit polynomials
modulo 2**64 with a finaliser, equal in every task and session.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


BYTE_CODES = seeds(256, 17)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    size = 1 << max(20, int(n).bit_length())
    return _powers(size)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[i] * base**i``; with :func:`slice_hash` the hash of any slice."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 13) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1), row + rows, len(column))
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each text's first word (one more entry than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word at the end of a text and one at the start of the next
    first[cuts] = True
    last[cuts - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    codes = BYTE_CODES[LOWER][data] if lower else BYTE_CODES[data]
    return slice_hash(prefix_sums(codes), starts, ends)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``codes[i:i+k]`` for each i that has k codes after it."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = prefix_sums(codes)
    return mix((sums[k:] - sums[:n]) * powers(len(sums))[1][:n])


def anchors(gram: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``window`` units that lie within one text: their starts, and each one's anchor.

    The anchor is the position of the window's smallest ``k``-gram, the leftmost of
    equals.  It depends on nothing but the window's content, so equal windows have
    equal anchors at equal places, and neighbouring windows mostly share one.
    ``bounds`` has the first unit of each text and the end.
    """
    w = window - k + 1
    n = int(bounds[-1]) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (gram & ~U64(0xFFFFFFFF)) | np.arange(len(gram), dtype=U64)
    span = 1
    while span * 2 <= w:  # minima of 2, 4, 8 ... neighbours
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span:])
    where = (key[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(n + 1, np.int32)  # starts that have a whole window in their text
    lo, hi = bounds[:-1], bounds[1:] - window + 1
    fits = hi > lo
    np.add.at(ok, lo[fits], 1)
    np.add.at(ok, np.minimum(hi[fits], n), -1)
    starts = np.flatnonzero(np.cumsum(ok[:n]) > 0)
    return starts, where[starts]


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks every unit of ``start + [0, length)``."""
    count = np.zeros(n + 1, np.int32)
    np.add.at(count, start, 1)
    np.add.at(count, np.minimum(start + length, n), -1)
    return np.cumsum(count[:n]) > 0
