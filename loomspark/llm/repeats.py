"""Which keys may occur more than once: a bitmap, found range by range.

A key's first FINE bits are its fine place, the first 12 of them its range. Each task sorts the fine places of some
million keys and sends them, as differences of some three bytes, to the task that owns their range. That one meets a
range's places one range at a time, so it holds some 4096th of all keys, and sorts them: fine places met again are
those of repeated keys. They are marked in a bitmap by their first BITS bits; 2**BITS / 8 bytes = 32 MB in all are
broadcast. A key that is not repeated passes where a repeated one has the same first BITS bits, or any other the same
fine place: what passes by chance grows with the keys that do repeat, not with all of them, until all are some
2**FINE. Whoever uses the filter must check what passes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, FINE = 28, 40
_RANGES = 1 << 12
#: Bits of the bitmap, and fine places, that a range has.
_SPAN, _FINE_SPAN = 1 << (BITS - 12), 1 << (FINE - 12)
_TOLD = 1 << 20


def places(keys: np.ndarray, bits: int = FINE) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _tell(kept: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    at, own = np.concatenate(kept), np.concatenate([*owners, np.zeros(0, np.uint16)])
    if len(own):
        both = np.sort(at.astype(np.uint64) << np.uint64(16) | own)  # np.unique hashes integers, far slower where most differ
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        at, own = (both >> np.uint64(16)).astype(np.int64), both.astype("<u2")
    else:
        at = np.sort(at)
    bounds = np.searchsorted(at, np.arange(_RANGES + 1, dtype=np.int64) * _FINE_SPAN)
    some = np.flatnonzero(np.diff(bounds))
    steps = np.diff(at, prepend=0)
    steps[bounds[some]] = at[bounds[some]] - some * _FINE_SPAN
    # Byte by byte, so that the many zeros of the high ones compress.
    steps = np.ascontiguousarray(steps.astype("<u4")).view(np.uint8).reshape(-1, 4)
    spans = list(zip(bounds[some].tolist(), bounds[some + 1].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([steps[a:b].T.tobytes() for a, b in spans], pa.binary()), pa.array([own[a:b].tobytes() for a, b in spans], pa.binary())], ["range", "steps", "owners"])


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """The bits of ranges that have fine places met again, or with another owner."""
    met: dict[int, list[np.ndarray]] = {}
    owned = False
    for b in batches:
        for r, steps, owners in zip(b.column("range").to_pylist(), b.column("steps"), b.column("owners"), strict=True):
            at = np.ascontiguousarray(np.frombuffer(steps.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            at = np.cumsum(at, dtype=np.uint64) << np.uint64(16)
            own = np.frombuffer(owners.as_buffer(), "<u2")
            owned |= len(own) > 0
            met.setdefault(r, []).append(at | own if len(own) else at)
    for r, parts in met.items():
        both = np.sort(np.concatenate(parts))
        at = both >> np.uint64(16)
        again = at[1:] == at[:-1]
        if owned:
            again &= both[1:] != both[:-1]
        if again.any():
            bits = np.zeros(_SPAN, bool)
            bits[(at[1:][again] >> np.uint64(FINE - BITS)).astype(np.int64)] = True
            packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed], pa.binary())], ["range", "bits"])


def _merge_in_order(batches) -> Iterator[pa.RecordBatch]:
    """Task side: _merge of rows in order of their range, holding one range at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        r = b.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if last != r[i]:
                yield from _merge(held)
                held, last = [], r[i]
            held.append(b.slice(i, j - i))
    yield from _merge(held)


def repeated(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray | None]]]):
    """A broadcast of the places that more than one key of rows has, or more than one owner.

    keys: of a task's batches the arrays of its keys, each with the keys' owners (16 bits of a hash of key and
    owner) or None."""

    def run(batches):
        kept, owners, size = [], [], 0
        for x, own in keys(batches):
            kept.append(places(x))
            if own is not None:
                owners.append(own)
            size += len(x)
            if size >= _TOLD:
                yield _tell(kept, owners)
                kept, owners, size = [], [], 0
        if size:
            yield _tell(kept, owners)

    told = rows.mapInArrow(run, "range int, steps binary, owners binary").repartition("range").sortWithinPartitions("range").mapInArrow(_merge_in_order, "range int, bits binary")
    out = np.zeros((_RANGES, _SPAN // 8), np.uint8)
    for r, bits in told.collect():  # 4096 ranges of 8 KB at most
        out[r] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.ravel())


def may_repeat(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = places(keys, BITS)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
