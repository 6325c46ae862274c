"""Vectorised hashing of the words of many texts at once, straight from Arrow's buffers.

Words are maximal runs of bytes that are not ASCII white space (0x20, 0x09-0x0D). A word's hash is a
polynomial in random 64-bit values of its bytes, read off a running sum, so that no Python object is
made for a word. All constants come from the splitmix64 generator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed in one go; one longer text is taken alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    part = x >> _U(30)
    x = x ^ part
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, _U(27), out=part)
    x *= _U(0x94D049BB133111EB)
    x ^= np.right_shift(x, _U(31), out=part)
    return x


def random_values(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = random_values(256, 1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse**i modulo 2**64 for i < n, kept for the next call."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            values = np.full(max(n, CHUNK_BYTES + 4096), base, _U)
            values[0] = 1
            _POWERS[name] = np.multiply.accumulate(values)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def running_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * _BASE**i, with a leading 0: span_hash reads any span off it."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal contents give equal hashes wherever they stand."""
    _, down = _powers(len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Some consecutive rows of a batch: their bytes, and where each row's text starts and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[Chunk]:
    """A text column in pieces of about CHUNK_BYTES; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield Chunk(row, every[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


@dataclass
class Words:
    """The words of a chunk: their spans, the row each belongs to, their hashes, and words per row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def words_of(chunk: Chunk, lower: bool = False) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    solid = ~SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = chunk.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, chunk.offsets)
    counts = np.diff(bounds)
    return Words(start, end, np.repeat(np.arange(chunk.rows), counts), span_hash(running_hash(_BYTE[data]), start, end), counts)


def shingles(words: Words, k: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in order, and how many each row has.

    With whole_if_short a row of 1 to k-1 words has one, of all its words."""
    n = len(words.hash)
    first = np.concatenate(([0], np.cumsum(words.counts)))[:-1]
    out, per_row = np.zeros(0, _U), np.maximum(words.counts - k + 1, 0)
    if n >= k:
        value = words.hash[: n - k + 1]
        for j in range(1, k):
            value = mix(value * _U(0xA0761D6478BD642F) + words.hash[j : n - k + 1 + j])
        out = value[words.row[: n - k + 1] == words.row[k - 1 :]]
    if whole_if_short and (short := np.flatnonzero((words.counts > 0) & (words.counts < k))).size:
        value = words.hash[first[short]]
        for j in range(1, k - 1):
            more = words.counts[short] > j
            value[more] = mix(value[more] * _U(0xE7037ED1A0B428DB) + words.hash[first[short][more] + j])
        value = mix(value + words.counts[short].astype(_U))
        place = np.cumsum(per_row)[short]
        out = np.insert(out, place, value)
        per_row[short] = 1
    return out, per_row


def row_sets(values: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and how many there are."""
    values = values.copy()
    bounds = np.concatenate(([0], np.cumsum(per_row)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    heads = bounds[:-1][per_row > 0]
    new[heads] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return values[new], total[bounds[1:]] - total[bounds[:-1]]


def bitmaps(values: np.ndarray, per_row: np.ndarray, words: int) -> tuple[pa.Array, pa.Array]:
    """Of each row's values a bitmap as a list of 64-bit words, and how many bits it has."""
    bits = np.zeros((len(per_row), words * 64), bool)
    bits[np.repeat(np.arange(len(per_row)), per_row), (values % _U(words * 64)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(per_row) + 1, dtype=np.int32) * words), pa.array(packed.ravel())), pa.array(bits.sum(1).astype(np.int32))


def binaries(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """A binary column of each row's values, eight little-endian bytes each."""
    offsets = np.concatenate(([0], np.cumsum(per_row) * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(per_row), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).astype("<u8").tobytes())])
