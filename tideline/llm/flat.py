"""Texts as one byte array: the runs (words, tokenizer units) of a whole Arrow batch are found and hashed
by array operations, without a Python object for each of them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random value for each byte, for each of two independent hashes.
_VALUE = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWER = [np.cumprod(np.full(256, b, dtype=np.uint64)) for b in _BASE]
BLOCK = 500_000
#: A-Z to a-z, on arrays of bytes.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[first:last], offsets - first


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: tuple[int, ...]) -> list[np.ndarray]:
    before = np.cumsum(lengths) - lengths
    got, at = data[ranges(starts, lengths)], np.arange(int(lengths.sum()), dtype=np.int64)
    at -= np.repeat(before, lengths)
    out = []
    for k in which:
        power = _POWER[k]
        if len(at) and (most := int(lengths.max())) > len(power):
            power = np.cumprod(np.full(most, _BASE[k], dtype=np.uint64))
        value = _VALUE[k][got] * power[at]
        out.append(mix(np.add.reduceat(value, before) + lengths.astype(np.uint64)))
    return out


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """64-bit hashes of non-empty runs, worked off in blocks so that memory does not follow the batch."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in which]
    ends, parts, i = np.cumsum(lengths), [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
        parts.append(_hash(data, starts[i:j], lengths[i:j], which))
        i = j
    return [np.concatenate([p[k] for p in parts]) for k in range(len(which))]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length) of the maximal runs of bytes for which inside[byte], none over a text's end; and for
    each text the index of its first run (one more entry than texts)."""
    on = np.zeros(len(data) + 1, bool)
    on[:-1] = inside[data]
    first = on[:-1].copy()
    first[1:] &= ~on[:-2]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = on[edges]
    last = on[:-1] & ~on[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = on[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


#: Gives freed memory back to the system, where the C library can; a worker lives on from stage to stage.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def column_slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text."""
    _, offsets = flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()
    _trim(0)
