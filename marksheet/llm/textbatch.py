"""Array form of text for Arrow batches: byte buffers, word boundaries, word and n-gram hashes.

Used inside ``mapInArrow`` tasks, where Spark has already split the rows. A word is a maximal
run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit and depend on the bytes only, so
they agree across tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
LONG_WORD = 256
PIECE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _R + (b ^ np.uint64(0x5851F42D4C957F2D)))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES):
    """Rows in runs of about ``size`` text bytes (one row at least, whole rows always), so array
    work stays in bounded memory: yields (record batch, bytes, row offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
            yield batch.slice(a, b - a), data[off[a]: off[b]], off[a: b + 1] - off[a]
            a = b


def find_words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the index of each row's first word (rows + 1 long).
    ``space`` marks the bytes that are no part of a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = space[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = gap[:-1]
    edge[off] = True
    start = np.flatnonzero(edge[:-1] & ~gap)
    edge[1:n] = gap[1:]
    edge[off] = True
    end = np.flatnonzero(edge[1:] & ~gap) + 1
    return start, end, np.searchsorted(start, off)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes a step; very long words go through XXH64."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    size = end - start
    h = mix((eight[start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _R)
    rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    k = 8
    while len(rest):
        x = eight[start[rest] + k] & _LOW_BYTES[np.minimum(size[rest] - k, 8)]
        h[rest] = join_hash(h[rest], x)
        k += 8
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i]: end[i]].tobytes(), 7)
    return h


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries (built by doubling); rows are not told
    apart here: see ``inside``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if width & size:
            part = power[done: done + n]
            out = part.copy() if out is None else join_hash(out, part)
            done += size
        size *= 2
        if size > width:
            return out
        half = size // 2
        power = join_hash(power[: len(power) - half], power[half:])


def inside(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the ``n`` windows of ``width`` entries lie in one row."""
    ok = np.ones(max(n, 0), bool)
    for a in first[1:-1]:  # windows that cross the start of a row
        ok[max(0, a - width + 1): a] = False
    return ok


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row, whose entries start at ``first``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def int_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
