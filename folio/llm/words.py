"""Vectorised word splitting and hashing over Arrow string columns.

Every operator that looks at words shares these helpers.  They work on the UTF-8 bytes of
a whole batch at once, so a word costs a few array operations and no Python object.

A text is lower-cased on A-Z only.  Two word rules are in use:

* ``SPACED``: runs of anything but space and 0x09-0x0D;
* ``ALNUM``: runs of ASCII letters and digits and of every non-ASCII byte.

Null texts count as empty, whole texts are read, and no word is longer than the helpers can
take: a word of many kilobytes is hashed eight bytes at a time like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_LONG = 256
#: Text bytes that one numpy pass takes; bounds the temporary arrays of a task.
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S29)
    h = h * _M2
    return h ^ (h >> _S33)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
    del batch, offsets
    pa.default_memory_pool().release_unused()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


class Words:
    """The words of a batch: ``starts``/``ends`` in ``data``, and ``first[i]:first[i + 1]`` for text i."""

    def __init__(self, column: pa.Array, kind: np.ndarray = SPACED):
        self.data, self.offsets = raw(column)
        self.n = len(self.offsets) - 1
        inside = kind[self.data]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[edge] = False
            after[edge - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes everywhere."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[: len(self.data)] = _LOWER[self.data] if lower else self.data
        view = np.lib.stride_tricks.sliding_window_view(data, 8)
        length = self.ends - self.starts
        h = length.astype(np.uint64) * _A + _C
        todo, at, left = None, self.starts, length
        for k in range(0, _LONG, 8):
            part = view[at].view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
            if todo is None:
                h = mix((h ^ part) * _B)
            else:
                h[todo] = mix((h[todo] ^ part) * _B)
            more = np.flatnonzero(left > 8)
            if not len(more):
                return h
            todo = more if todo is None else todo[more]
            at, left = at[more] + 8, left[more] - 8
        for i in todo:  # words of over 256 bytes are few; their length is no concern to the digest
            word = data[self.starts[i] : self.ends[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; entry i starts at word i, the last size - 1 are left out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0x5851F42D4C957F2D + 0x14057B7EF767814F & (2**64 - 1) | 1
        out += h[k : k + n] * np.uint64(factor)
    return mix(out)
