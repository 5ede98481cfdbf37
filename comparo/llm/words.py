"""Words of a batch of texts as arrays: where they start and end, and 64-bit hashes of them.

Texts arrive as one Arrow column; a batch is handled in chunks of whole documents with about
``CHUNK_BYTES`` bytes of text, so the arrays of a task stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SLICE_ROWS = 512

_rng = np.random.default_rng(20240901)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALPHANUMERIC = ~_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1024, 1 << (n - 1).bit_length()))[:n]


class Words(NamedTuple):
    """Words of some documents: `first[d]:first[d + 1]` are those of document d."""

    data: np.ndarray    # bytes of the texts
    bounds: np.ndarray  # where the documents begin in data, and the end
    start: np.ndarray   # of each word in data
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        at = np.arange(len(self.data), dtype=np.int64)
        base = np.zeros(len(self.data), np.int64)
        base[self.start] = self.start
        at -= np.maximum.accumulate(base)
        np.minimum(at, int(lengths.max()), out=at)
        value = _BYTE[self.data] * powers(int(_P), int(lengths.max()) + 1)[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        return mix((sums[self.end] - sums[self.start]) ^ (lengths.astype(np.uint64) * _Q))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(
        column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]] if len(bounds) else raw, bounds - bounds[0]


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `limit` bytes each, one document at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, j
        i = j


def split(data: np.ndarray, bounds: np.ndarray, members: np.ndarray = NOT_SPACE) -> Words:
    """Words are the longest runs of `members` bytes within a document."""
    inside = members[data]
    edges = bounds[1:-1]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges[edges < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def batches(column, members: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) of each chunk of a text column, which is read a few
    rows at a time, so that no second copy of it is made."""
    for at in range(0, len(column), SLICE_ROWS):
        data, bounds = text_column(column.slice(at, SLICE_ROWS))
        for i, j in chunks(bounds):
            part = data[bounds[i]:bounds[j]]
            yield at + i, at + j, split(LOWER[part] if lower else part, bounds[i:j + 1] - bounds[i], members)
        del data
    pa.default_memory_pool().release_unused()


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (documents are not told apart)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= _Q
            out += hashes[j:n + j]
        return mix(out)
    inverse = pow(int(_Q), -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum(hashes * powers(int(_Q), len(hashes)), dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * powers(inverse, n))


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """First words of the windows of k words that lie within one document."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    starts = np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    return starts + np.arange(int(n.sum()))


def packed(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones: the highest are mostly zero."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpacked(data, kind) -> np.ndarray:
    """The values of :func:`packed`."""
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
