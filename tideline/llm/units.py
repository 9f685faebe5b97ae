"""Byte-level BPE works on pieces that never span a change from other characters to white space. A text cut
at such changes gives units whose token ids, joined, are the ids of the whole text. Most units repeat, so a
bounded table of them saves most of the work.

The cuts are made before a white space character of ASCII that follows a character that is not white space,
in Unicode's sense; this holds for every text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tideline.llm.flat import flat, hashes, ranges

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def wide_white_ends(data: np.ndarray) -> np.ndarray:
    """Where a white space character of two or three bytes ends."""
    out = np.zeros(len(data), bool)
    for lead, tails in (
        ((0xC2,), (0x85, 0xA0)),
        ((0xE1, 0x9A), (0x80,)),
        ((0xE2, 0x80), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
        ((0xE2, 0x81), (0x9F,)),
        ((0xE3, 0x80), (0x80,)),
    ):
        at = np.flatnonzero(data[: len(data) - len(lead)] == lead[0]) if len(data) > len(lead) else np.zeros(0, int)
        for k, byte in enumerate(lead[1:], 1):
            at = at[data[at + k] == byte]
        at = at + len(lead)
        out[at[np.isin(data[at], tails)]] = True
    return out


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    white = WHITE[data]
    first = white.copy()
    first[1:] &= ~(white[:-1] | wide_white_ends(data)[:-1])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(first)


class UnitTable:
    """Token ids of units, by a pair of 64-bit hashes. make(data, starts, lengths) gives the ids of new units, many
    at once, as (number of ids of each, all ids).
    Beyond `limit` units only those stay that have been met again since the last such time, so that the table
    never grows with the data and rare units do not push out frequent ones; units over `longest` bytes are made
    each time."""

    def __init__(self, make: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = 600_000, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, bool)
        self.pool = np.zeros(0, np.int32)

    def _make_room(self, more: int) -> None:
        keep = np.flatnonzero(self.met)
        if len(keep) + more > self.limit:
            self._clear()
            return
        self.pool = self.pool[ranges(self.start[keep], self.size[keep])]
        self.key, self.check, self.size = self.key[keep], self.check[keep], self.size[keep]
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.met = np.zeros(len(keep), bool)

    def _made(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, ids = self.make(data, starts, lengths) if len(starts) else (np.zeros(0), np.zeros(0))
        return size.astype(np.int32), ids.astype(np.int32)

    def _learn(self, data, starts, lengths, key, check) -> None:
        """Units that are not yet in the table; key is sorted and has no repeats."""
        sizes, pool = self._made(data, starts, lengths)
        begin = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.pool = np.concatenate([self.pool, pool])
        joined = np.concatenate([self.key, key])
        order = np.argsort(joined, kind="stable")
        self.key = joined[order]
        self.check = np.concatenate([self.check, check])[order]
        self.start = np.concatenate([self.start, begin])[order]
        self.size = np.concatenate([self.size, sizes])[order]
        self.met = np.concatenate([self.met, np.zeros(len(key), bool)])[order]

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return at, (self.key[at] == key if len(self.key) else np.zeros(len(key), bool))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, one after another; for each text the index of its first id, and the end)."""
        starts, offsets, pool, begin, size = self._units(column)
        ends = np.concatenate([[0], np.cumsum(size)])
        return pool[ranges(begin, size)], ends[np.searchsorted(starts, offsets)]

    def boundaries(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte of each unit of all texts, one after another; number of tokens before each and in all; first
        byte of each text, and the end)."""
        starts, offsets, _, _, size = self._units(column)
        return starts, np.concatenate([[0], np.cumsum(size)]), offsets

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte of each unit, first byte of each text, pool of ids, where each unit's ids are there, how many)."""
        data, offsets = flat(column)
        starts = unit_starts(data, offsets)
        lengths = np.diff(starts, append=len(data))
        short = lengths <= self.longest
        key, check = hashes(data, starts[short], lengths[short], (0, 1))
        unique, at, back = np.unique(key, return_index=True, return_inverse=True)
        place, known = self._places(unique)
        self.met[place[known]] = True
        if not known.all():
            if len(self.key) + int((~known).sum()) > self.limit:
                self._make_room(int((~known).sum()))
                _, known = self._places(unique)
            new = at[~known]
            self._learn(data, starts[short][new], lengths[short][new], unique[~known], check[new])
        place, _ = self._places(unique)
        size, begin = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        size[short], begin[short] = self.size[place][back], self.start[place][back]
        #: Long units, and any whose second hash differs from the table's.
        odd = ~short
        odd[np.flatnonzero(short)[self.check[place][back] != check]] = True
        pool = self.pool
        if odd.any():
            sizes, more = self._made(data, starts[odd], lengths[odd])
            size[odd], begin[odd] = sizes, len(pool) + np.cumsum(sizes, dtype=np.int64) - sizes
            pool = np.concatenate([pool, more])
        return starts, offsets, pool, begin, size
