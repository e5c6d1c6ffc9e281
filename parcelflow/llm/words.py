"""Word boundaries and word hashes of many texts at once, on Arrow's UTF-8 buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. All work is vectorised over the bytes of a slice of a batch, so the
temporary arrays stay within a few times ``SLICE_BYTES`` however many rows a batch has (one longer text is
its own slice).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``limit`` bytes of text each."""
    column = batch.column(text)
    if len(column) == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(column)], strict=True):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each text in them; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])  # drops the offset of a slice
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: ``start`` and ``end`` in ``data``; text i has words first[i] to first[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        space = _SPACE[data]
        cut = np.ones(len(data) + 1, dtype=bool)  # a word may begin here: after white space, or at a text's start
        cut[1:] = False
        if len(data):
            cut[1:][space] = True
            cut[offsets] = True
            self.start = np.flatnonzero(~space & cut[:-1])
            last = np.ones(len(data), dtype=bool)
            last[:-1] = space[1:]
            last[offsets[1:][offsets[1:] > 0] - 1] = True
            self.end = np.flatnonzero(~space & last) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        todo, at = np.arange(len(size)), 0
        while len(todo):
            left = size[todo] - at
            block = eight[self.start[todo] + at] & _LOW_BYTES[np.minimum(left, 8)]
            out[todo] = mix(out[todo] ^ block)
            todo, at = todo[left > 8], at + 8
        return out


def windowed(hashes: np.ndarray, n: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The hash of each ``n`` consecutive word hashes (text boundaries are the caller's)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(multiplier) + hashes[i : i + size]
    return mix(out)
