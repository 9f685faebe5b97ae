"""Byte-level BPE encoding and decoding by merge replay.

Words (matches of the tokenizer's pattern) are laid out in one array of symbols. An inverted index from the
token that a pair of symbols makes to the pair's positions drives the merges: the lowest rank comes first,
over all words that have it, and each merge looks at its two neighbours only. Merges never cross words, so
the index of a task's slice of the corpus gives what one index of the whole corpus would; no shuffle is
needed and the memory is that of a batch's new words."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import text_of
from tideline.llm.flat import column_slices, ranges
from tideline.llm.units import UnitTable


class MergeReplay:
    """Encodes words by the ranks of a .tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: Every pair of tokens that makes a token, sorted, and what it makes.
        made = sorted(
            (self.ranks[b[:k]] << 32 | self.ranks[b[k:]], i)
            for b, i in self.ranks.items()
            for k in range(1, len(b))
            if b[:k] in self.ranks and b[k:] in self.ranks
        )
        self.pair = np.array([x for x, _ in made], np.int64)
        self.makes = np.array([x for _, x in made], np.int32)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens that pairs make, -1 for none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.makes[at], -1)

    def replay(self, words: list[bytes], stepwise: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids).

        All places of the lowest rank merge at once. A merge may make a pair that ranks before the one it came
        from; the other places of that rank in such a word should have waited. These few words are done again,
        stepwise: of each word only the leftmost place merges, and the others go back into the index."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n, start = len(symbol), np.cumsum(length) - length
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[start[length > 0]] = -1
        after[(start + length - 1)[length > 0]] = -1
        #: The token that the pair beginning at a place makes; -1 where there is none or no symbol any more.
        token = np.full(n, -1, np.int32)
        paired = np.flatnonzero(after >= 0)
        token[paired] = self.merged(symbol[paired], symbol[paired + 1])
        whole = [k for k, w in enumerate(words) if w in self.ranks]  # as the library does, before any merge
        for k in whole:
            token[start[k] : start[k] + length[k]] = -1
        places = np.flatnonzero(token >= 0)
        places = places[np.argsort(token[places], kind="stable")]
        ranks, first = np.unique(token[places], return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [p] for r, p in zip(ranks.tolist(), np.split(places, first[1:]))} if len(ranks) else {}
        heap, early = ranks.tolist(), []

        def enter(rank: int, where: np.ndarray) -> None:
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(where)

        while heap:
            rank = heapq.heappop(heap)
            p = np.unique(np.concatenate(index.pop(rank)))
            p = p[token[p] == rank]
            if stepwise and len(p) > 1:
                word = np.searchsorted(start, p, side="right")
                leftmost = np.append(True, word[1:] != word[:-1])
                if not leftmost.all():
                    enter(rank, p[~leftmost])
                p = p[leftmost]
            elif len(p) > 1 and len(chained := np.flatnonzero(after[p[:-1]] == p[1:])):
                #: Of places that overlap, as in "aaaa", the first, third and so on of each chain merge.
                link = np.zeros(len(p), bool)
                link[chained + 1] = True
                at = np.arange(len(p))
                p = p[(at - np.maximum.accumulate(np.where(link, 0, at))) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            nxt = after[q]
            symbol[p], symbol[q], token[q], after[p] = rank, -1, -1, nxt
            inner = nxt >= 0
            before[nxt[inner]] = p[inner]
            prev = before[p]
            left = np.concatenate([p[inner], prev[prev >= 0]])
            token[p] = -1
            if not len(left):
                continue
            made = self.merged(symbol[left], symbol[after[left]])
            token[left] = made
            left, made = left[made >= 0], made[made >= 0]
            if not len(left):
                continue
            if not stepwise and int(made.min()) < rank:
                early.append(np.searchsorted(start, left[made < rank], side="right") - 1)
            order = np.argsort(made, kind="stable")
            left, made = left[order], made[order]
            cut = np.flatnonzero(made[1:] != made[:-1]) + 1
            for t, where in zip(made[np.concatenate([[0], cut])].tolist(), np.split(left, cut)):
                enter(t, where)
        for k in whole:
            symbol[start[k] : start[k] + length[k]] = -1
            symbol[start[k]] = self.ranks[words[k]]
        if early:
            again = np.unique(np.concatenate(early)).tolist()
            size, ids = self.replay([words[k] for k in again], stepwise=True)
            for k, end, m in zip(again, np.cumsum(size).tolist(), size.tolist()):
                symbol[start[k] : start[k] + length[k]] = -1
                symbol[start[k] : start[k] + m] = ids[end - m : end]
        alive = np.concatenate([[0], np.cumsum(symbol >= 0)])
        return alive[start + length] - alive[start], symbol[symbol >= 0]

    def words_of(self, unit: str) -> list[str]:
        """The pattern's matches; letters with at most one mark after them need no search."""
        body = unit[1:] if unit[0] == " " else unit
        if body and max(body) < "\u0250":
            if body.isalpha():
                return [unit]
            if body[-1] in ".,;:!?" and body[:-1].isalpha():
                return [unit[:-1], unit[-1]]
        return self.split(unit)

    def encode_units(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, all ids) of texts that are split alone as they are within a longer text."""
        split = [self.words_of(data[a : a + n].tobytes().decode()) for a, n in zip(starts.tolist(), lengths.tolist())]
        number = {w: k for k, w in enumerate({w for ws in split for w in ws})}
        size, ids = self.replay([w.encode() for w in number])
        begin = np.cumsum(size) - size
        each = np.fromiter(map(len, split), np.int64, len(split))
        of = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(each.sum()))
        total = np.concatenate([[0], np.cumsum(size[of])])
        ends = np.cumsum(each)
        return total[ends] - total[ends - each], ids[ranges(begin[of], size[of])]


_TABLES: dict[tuple[str, str], tuple[MergeReplay, UnitTable, np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(path: str, pattern: str):
    if (path, pattern) not in _TABLES:
        bpe = MergeReplay(path, pattern)
        n = max(bpe.bytes_of) + 1
        size = np.zeros(n, np.int64)
        for i, b in bpe.bytes_of.items():
            size[i] = len(b)
        start = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(bpe.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        _TABLES[path, pattern] = bpe, UnitTable(bpe.encode_units), start, size, pool
    return _TABLES[path, pattern]


def decode(ids: np.ndarray, start: np.ndarray, size: np.ndarray, pool: np.ndarray) -> bytes:
    """Ids back to bytes, a block at a time."""
    step = 500_000
    return b"".join(
        pool[ranges(start[x], size[x])].tobytes() for x in (ids[i : i + step] for i in range(0, len(ids), step))
    )


def encode_decode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (the decoded bytes) and, on request, the ids (array) and the decoded text.

    Null and empty texts have no tokens. A null id stays null. Repeated rows each give a row. Extra columns
    are ignored. path must be readable on every executor, as the tokenizer's package is."""
    more = ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, start, size, pool = _tables(path, pattern)
        for whole in batches:
            for batch in column_slices(whole, "text"):
                ids, ends = table.encode(batch.column("text"))
                parts = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                out = {
                    "id": batch.column("id"),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in parts], pa.string()),
                }
                raw = [decode(x, start, size, pool) for x in parts]
                out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
                if with_ids:
                    out["ids"] = pa.array(parts, pa.list_(pa.int32()))
                if with_text:
                    out["decoded"] = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(docs[id_column].alias("id"), text_of(docs[text_column]).alias("text"))
    out = given.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_column)
