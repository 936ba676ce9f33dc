"""Splitting whole columns of texts into words, on their UTF-8 bytes, with numpy.

A split is described by two tables of 256 entries: which bytes belong to a word,
and what each byte turns into. Bytes from 0x80 on are parts of non-ASCII
characters, so byte classes and character classes agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _LOWER

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


#: Values that are summed at once.
_CHUNK = 1 << 20


@dataclass
class Words:
    """All words of a batch in order. ``bounds[r]:bounds[r + 1]`` are those of row r."""

    words: pa.Array
    bounds: np.ndarray
    starts: np.ndarray  # byte positions in ``data``
    ends: np.ndarray
    data: np.ndarray
    row_bytes: np.ndarray  # bounds of the rows in ``data``

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the bounds of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.type not in (pa.large_string(), pa.string()):
        column = column.cast(pa.large_string()).fill_null("")
    kind = np.int64 if column.type == pa.large_string() else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(column: pa.Array, member: np.ndarray, change: np.ndarray) -> Words:
    """Holds about 7 bytes for each byte of the column at its peak."""
    data, rows = raw(column)
    if change is not IDENTITY:
        data = change[data]
    inside = member[data]
    n = len(data)
    small = np.int32 if n < 2**31 - 1 else np.int64

    def edges(at: np.ndarray, step: int) -> np.ndarray:
        """Words' first bytes (step 1) or last ones (-1); ``at`` are those of the rows."""
        found = inside.copy()
        if step > 0:
            found[1:] &= ~inside[:-1]
        else:
            found[:-1] &= ~inside[1:]
        found[at] = inside[at]
        return np.flatnonzero(found).astype(small)

    starts = edges(rows[:-1][rows[:-1] < n], 1)
    ends = edges(rows[1:][rows[1:] > 0] - 1, -1) + small(1)
    bounds = np.searchsorted(starts, rows)
    bounds[-1] = len(starts)
    offsets = np.zeros(len(starts) + 1, small)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary() if small is np.int32 else pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return Words(words, bounds, starts, ends, data, rows)


def sums(values: np.ndarray, bounds: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """The sum of ``values`` in each row of ``bounds``, which cover them all; empty rows have 0."""
    out, at = np.zeros(len(bounds) - 1, kind), 0
    held = 0  # of the row that has begun
    for i in range(0, len(values), _CHUNK):
        part = np.cumsum(values[i : i + _CHUNK], dtype=np.int64)
        end = int(np.searchsorted(bounds, i + len(part), side="right"))  # bounds before are in this chunk or earlier ones
        ends = bounds[max(1, at) : end].astype(np.int64) - i - 1
        before = np.where(ends >= 0, part[np.maximum(ends, 0)], 0)
        if len(before):
            first = max(1, at) - 1
            out[first : first + len(before)] = np.diff(before, prepend=0)
            out[first] += held
            held = int(part[-1] - before[-1])
        else:
            held += int(part[-1])
        at = end
    return out


def pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of integers: the high bytes of small values are runs of zeros."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes | pa.Buffer) -> np.ndarray:
    data = pa.py_buffer(data)
    size = 8 * int.from_bytes(data.slice(0, 8).to_pybytes(), "little")
    planes = pa.Codec("zstd").decompress(data.slice(8), decompressed_size=size) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads small integers over the whole range."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
