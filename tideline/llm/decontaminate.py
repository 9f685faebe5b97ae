"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds every run of words of the test items. Training words stream through it; the automaton
tracks the longest run that ends at each word and is in an item. Runs of a window's length or more are hits,
and the state tells which items they come from.

Test items may be many: Spark tasks cut long ones into overlapping pieces, build one automaton for each shard
of bounded size and write it, as sorted arrays, to the shared folder. Workers read from there as many as fit
`group_bytes`; if there are more, the documents are passed once for each such group."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORDS, carried_columns, materialised, shared_dir, text_of
from tideline.llm.flat import column_slices, flat, hashes, ranges, runs

_INSIDE = np.array([WORDS[b] != 32 for b in range(256)])
_FOLD = np.frombuffer(WORDS, np.uint8)
_ON = np.array([False, True])
#: Words of a run that one automaton walks in step with others; longer runs go in pieces that overlap.
STRIDE = 512


class _Builder:
    """Suffix automaton over sequences of word numbers, as it grows."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> list[int]:
        """The states of the prefixes."""
        out, last = [], 0
        for w in words:
            last = self._extend(last, w)
            out.append(last)
        return out

    def _extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, w, there)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy


def _grouped(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct first values of sorted pairs, where each one's rows begin and the end)."""
    keys, first = np.unique(pairs[:, 0], return_index=True)
    return keys.astype(np.int32), np.append(first, len(pairs)).astype(np.int32)


class SuffixAutomaton:
    """A finished automaton as arrays: `moves` are sorted (state, word) pairs and `to` the states they lead to."""

    ARRAYS = (
        "value", "number", "moves", "to", "root", "link", "length", "base", "short",
        "held", "held_at", "held_item", "own", "own_at", "own_size", "own_item",
    )

    @classmethod
    def built(cls, items: list[tuple[str, list[bytes]]], window: int) -> SuffixAutomaton:
        self, grow = cls(), _Builder()
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        names = {name: k for k, name in enumerate(dict.fromkeys(name for name, _ in items))}
        spelled = [(names[name], [vocabulary[w] for w in words]) for name, words in items if words]
        for _, words in spelled:
            grow.add(words)
        n = len(grow.length)
        self.window, self.names = window, list(names)
        self.least = min((min(len(w), window) for _, w in spelled), default=window)
        self.link, self.length = np.array(grow.link, np.int32), np.array(grow.length, np.int32)
        keys = np.fromiter((s << 32 | w for s, out in enumerate(grow.next) for w in out), np.int64)
        to = np.fromiter((t for out in grow.next for t in out.values()), np.int32)
        order = np.argsort(keys)
        self.moves, self.to = keys[order], to[order]
        self.root = np.zeros(len(vocabulary), np.int32)
        for w, t in grow.next[0].items():
            self.root[w] = t
        del grow
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        (value,) = hashes(data, np.cumsum(size) - size, size)
        self.number = np.argsort(value).astype(np.int32)
        self.value = value[self.number]
        #: For each state: the state of its last `window` words, and that of the longest short item it ends with.
        self.base, self.short = np.zeros(n, np.int32), np.zeros(n, np.int32)
        held, own = [], []
        for k, words in spelled:
            if len(words) < window:
                own.append((self._walk(words)[-1], len(words), k))
        ends = {s for s, _, _ in own}
        for v in np.argsort(self.length, kind="stable")[1:].tolist():
            up = self.link[v]
            self.base[v] = v if self.length[up] < window <= self.length[v] else self.base[up]
            self.short[v] = v if v in ends else self.short[up]
        for k, words in spelled:
            if len(words) >= window:
                states = self.base[self._walk(words)[window - 1 :]]
                held.append(np.stack([states, np.full(len(states), k)], 1))
        pairs = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.int64)
        (self.held, self.held_at), self.held_item = _grouped(pairs), pairs[:, 1].astype(np.int32)
        triples = np.unique(np.array(own, np.int64).reshape(-1, 3), axis=0)
        (self.own, self.own_at), self.own_size, self.own_item = _grouped(triples), triples[:, 1].astype(np.int32), triples[:, 2].astype(np.int32)
        return self

    def _walk(self, words: list[int]) -> np.ndarray:
        out, v = np.zeros(len(words), np.int64), np.zeros(1, np.int64)
        for i, w in enumerate(words):
            v = self._go(v, np.array([w]))
            out[i] = v[0]
        return out

    def packed(self) -> bytes:
        out = io.BytesIO()
        facts = json.dumps({"window": self.window, "least": self.least, "names": self.names}).encode()
        np.savez(out, facts=np.frombuffer(facts, np.uint8), **{a: getattr(self, a) for a in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> SuffixAutomaton:
        self = cls()
        with np.load(io.BytesIO(raw)) as kept:
            for a in cls.ARRAYS:
                setattr(self, a, kept[a])
            for k, v in json.loads(kept["facts"].tobytes()).items():
                setattr(self, k, v)
        return self

    def _go(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        out = self.root[word].astype(np.int64)
        inner = np.flatnonzero(state)
        if len(inner):
            key = state[inner] << 32 | word[inner]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            out[inner] = np.where(self.moves[at] == key, self.to[at], -1)
        return out

    def hits(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(run, first word of the hit, end, item or -1) of all hits in the runs [begin, end) of known words. All
        runs take a step at a time; one that fails goes on from its state's suffix link."""
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, run = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -i))
            w, v, r = word[begin[:m] + i], state[:m], run[:m]
            to = self._go(v, w)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                v[stuck] = self.link[v[stuck]]
                r[stuck] = self.length[v[stuck]]
                to[stuck] = self._go(v[stuck], w[stuck])
                stuck = stuck[to[stuck] < 0]
            v[:], r[:] = to, r + 1
            at = np.flatnonzero(r >= self.window)
            if len(at):
                upto = begin[at] + i + 1
                yield order[at], upto - r[at], upto, self.base[v[at]]
            at = np.flatnonzero(self.short[v]) if len(self.own) else at[:0]
            ending = self.short[v[at]]
            while len(at):
                k = np.searchsorted(self.own, ending)
                rows = ranges(self.own_at[k], self.own_at[k + 1] - self.own_at[k])
                who = np.repeat(at, self.own_at[k + 1] - self.own_at[k])
                fits = self.own_size[rows] <= r[who]
                who, rows = who[fits], rows[fits]
                upto = begin[who] + i + 1
                yield order[who], upto - self.own_size[rows], upto, -1 - self.own_item[rows]
                ending = self.short[self.link[ending]]
                at, ending = at[ending > 0], ending[ending > 0]

    def items_of(self, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, item) of hits, whose marks are base states or, below 0, short items; each once."""
        pairs = np.unique(np.stack([doc, mark], 1), axis=0)
        doc, mark = pairs[:, 0], pairs[:, 1]
        k = np.searchsorted(self.held, mark[mark >= 0])
        n = self.held_at[k + 1] - self.held_at[k]
        both = np.stack([np.append(np.repeat(doc[mark >= 0], n), doc[mark < 0]), np.append(self.held_item[ranges(self.held_at[k], n)], -1 - mark[mark < 0])], 1)
        both = np.unique(both, axis=0)
        return both[:, 0], both[:, 1]


def write_automata(benchmark: DataFrame, item_column: str, text_column: str, window: int, shard_words: int, group_bytes: int) -> tuple[str, list[list[int]]]:
    """Where the automata of all items lie, and their numbers in groups of about `group_bytes`. An automaton has
    at most shard_words words and one more piece of at most as many. The driver sees a number and a size each."""
    spark = benchmark.sparkSession
    piece = max(2 * window, shard_words // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode().translate(WORDS).split()
                for a in range(0, max(1, len(words) - window + 1), piece - window + 1):
                    own = words[a : a + piece]
                    yield pa.RecordBatch.from_pydict({"item": [item], "words": [b" ".join(own)], "n": [len(own)]})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            raw = SuffixAutomaton.built(held, window).packed()
            return pa.RecordBatch.from_pydict({"number": [part << 32 | made], "size": [len(raw)], "data": pa.array([raw], pa.binary())})

        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                held.append((item, words.split()))
                size += len(held[-1][1])
                if size >= shard_words:
                    yield done()
                    made, held, size = made + 1, [], 0
        if held:
            yield done()

    given = benchmark.select(F.coalesce(benchmark[item_column].cast("string"), F.lit("")).alias("item"), text_of(benchmark[text_column]).alias("text"))
    pieces = materialised(given.mapInArrow(cut, "item string, words binary, n long").where("n > 0"), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    path = shared_dir(spark, "benchmark-automata")
    dealt = pieces.select("item", "words").repartition(max(1, -(-total // shard_words)))
    materialised(dealt.mapInArrow(build, "number long, size long, data binary"), "benchmark-automata", into=path)
    groups: list[list[int]] = []
    room = 0
    for number, size in spark.read.parquet(path).select("number", "size").orderBy("number").toLocalIterator():
        if not groups or size > room:
            groups.append([])
            room = group_bytes
        groups[-1].append(number)
        room -= size
    return path, groups


_LOADED: dict[tuple[str, int], list[SuffixAutomaton]] = {}


def _load(path: str, numbers: list[int]) -> list[SuffixAutomaton]:
    """One group at a time is kept in a worker."""
    if not numbers:
        return []
    key = path, numbers[0]
    if key not in _LOADED:
        _LOADED.clear()
        system, base = fs.FileSystem.from_uri(path)
        kept = ds.dataset(base, filesystem=system, format="parquet").to_table(columns=["data"], filter=ds.field("number").isin(numbers))
        if kept.num_rows != len(numbers):
            raise ValueError(f"{path} has {kept.num_rows} of {len(numbers)} automata")
        _LOADED[key] = [SuffixAutomaton.unpacked(x.as_py()) for x in kept.column("data")]
    return _LOADED[key]


def _known_runs(known: np.ndarray, first: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, begin, end) of runs of words that occur in some item; any other word takes an automaton back to its
    start. Runs under `least` words are left out, and long ones cut into pieces that share all but one word of a
    window, so that every window is whole in one of them."""
    begin, size, upto = runs((known >= 0).view(np.uint8), first, _ON)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(upto))
    stride = max(STRIDE, 2 * window)
    doc, begin, size = (x[size >= least] for x in (doc, begin, size))
    pieces = 1 + np.maximum(0, -(-(size - stride) // (stride - window + 1)))
    nth = ranges(np.zeros(len(pieces), np.int64), pieces)
    end = np.repeat(begin + size, pieces)
    begin = np.repeat(begin, pieces) + nth * (stride - window + 1)
    return np.repeat(doc, pieces), begin, np.minimum(begin + stride, end)


class _Found:
    """What a slice of texts shares with the items."""

    def __init__(self, texts: pa.Array, automata: list[SuffixAutomaton]):
        data, self.offsets = flat(texts)
        self.start, self.length, self.first = runs(data, self.offsets, _INSIDE)
        (value,) = hashes(_FOLD[data], self.start, self.length)
        self.hit, self.items = np.zeros(len(value), bool), [set() for _ in range(len(texts))]
        for automaton in automata:
            at = np.minimum(np.searchsorted(automaton.value, value), len(automaton.value) - 1)
            known = np.where(automaton.value[at] == value, automaton.number[at], -1)
            doc, begin, end = _known_runs(known, self.first, automaton.least, automaton.window)
            found = list(automaton.hits(known, begin, end))
            if not found:
                continue
            run, low, high, mark = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(4))
            change = np.bincount(low, minlength=len(value) + 1) - np.bincount(high, minlength=len(value) + 1)
            self.hit |= np.cumsum(change)[:-1] > 0
            for d, k in zip(*(x.tolist() for x in automaton.items_of(mark, doc[run]))):
                self.items[d].add(automaton.names[k])

    def add(self, spans: pa.Array, items: pa.Array) -> None:
        """What an earlier pass found, as spans() and items gave it."""
        for d, (own, names) in enumerate(zip(spans.to_pylist(), items.to_pylist())):
            for a, b in zip(own[::2], own[1::2]):
                self.hit[self.first[d] + a : self.first[d] + b] = True
            self.items[d].update(names)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, size, upto = runs(self.hit.view(np.uint8), self.first, _ON)
        return begin, begin + size, upto

    def spans(self) -> list[list[int]]:
        """Begin and end of each hit run of words in turn, for each text."""
        begin, end, upto = self._runs()
        both = np.stack([begin, end], 1)
        return [(both[a:b] - f).ravel().tolist() if b > a else [] for a, b, f in zip(upto[:-1].tolist(), upto[1:].tolist(), self.first.tolist())]

    def byte_spans(self) -> list[list[tuple[int, int]]]:
        begin, end, upto = self._runs()
        low, high = self.start[begin], self.start[end - 1] + self.length[end - 1]
        return [list(zip((low[a:b] - at).tolist(), (high[a:b] - at).tolist())) if b > a else [] for a, b, at in zip(upto[:-1].tolist(), upto[1:].tolist(), self.offsets.tolist())]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, hit words) of each text."""
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return np.diff(self.first), np.diff(total[self.first])


def _passes(docs: DataFrame, text: str, path: str, groups: list[list[int]]) -> tuple[DataFrame, list[int], bool]:
    """docs after all groups but the last, with what they found as _spans and _items; the last group; and
    whether there were others."""
    for k, group in enumerate(groups[:-1]):
        later, names = k > 0, docs.columns[: len(docs.columns) - 2 * (k > 0)]

        def run(batches: Iterator[pa.RecordBatch], group=group, later=later, names=names) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in column_slices(whole, text):
                    found = _Found(batch.column(text), _load(path, group))
                    if later:
                        found.add(batch.column("_spans"), batch.column("_items"))
                    more = [pa.array(found.spans(), pa.list_(pa.int64())), pa.array([sorted(i) for i in found.items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "_spans", "_items"])

        kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
        docs = materialised(docs.mapInArrow(run, f"{kinds}, _spans array<long>, _items array<string>"), "decontamination-pass")
    return docs, groups[-1] if groups else [], len(groups) > 1


def match_items(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", window: int = 10, shard_words: int = 100_000, group_bytes: int = 64_000_000, keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated, and, on request,
    spans (hit spans in bytes of the text, end exclusive, in order).

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. A
    window is `window` consecutive words of an item, or a shorter item as a whole; items without words have
    none. Null and empty texts have no words; null item texts likewise; items that share an id count once.
    Very long texts and items are matched whole. A null id stays null, repeated rows each give a row, no rows
    give none. `keep` names columns to carry along (all, if None); one that is called as a result column is
    comes out as <name>_given."""
    path, groups = write_automata(benchmark, item_column, "text", window, shard_words, group_bytes)
    fields = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"} | ({"spans": "array<struct<start:long,end:long>>"} if with_spans else {})
    given, names, text = carried_columns(docs, docs.columns if keep is None else keep, text_column, fields)
    given, last, more = _passes(given, text, path, groups)
    plain = [f"c{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, text):
                found = _Found(batch.column(text), _load(path, last))
                if more:
                    found.add(batch.column("_spans"), batch.column("_items"))
                words, hit = found.counts()
                out = [
                    *(batch.column(c) for c in plain), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, found.items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in found.items], pa.string()), pa.array(hit > 0),
                ]
                if with_spans:
                    places = [[{"start": a, "end": b} for a, b in own] for own in found.byte_spans()]
                    out.append(pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(out, [*plain, *fields])

    schema = ", ".join([*(f"{c} {given.schema[c].dataType.simpleString()}" for c in plain), *(f"{c} {t}" for c, t in fields.items())])
    return given.mapInArrow(run, schema).toDF(*names, *fields)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", length_column: str | None = None, most_coverage: float = 0.5, window: int = 10, shard_words: int = 100_000, group_bytes: int = 64_000_000) -> DataFrame:
    """docs without what they share with the items: hit spans are cut from the text, rows with more than
    `most_coverage` of their words hit go altogether. Rows without hits, null and empty texts among them, stay
    as they are, and so do all other columns, but for one that counts characters, if it is named. Words and
    windows are those of match_items."""
    path, groups = write_automata(benchmark, item_column, "text", window, shard_words, group_bytes)
    given, names, text = carried_columns(docs, docs.columns, text_column)
    counted = f"c{names.index(length_column)}" if length_column else None
    given, last, more = _passes(given, text, path, groups)
    plain = [f"c{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, text):
                found = _Found(batch.column(text), _load(path, last))
                if more:
                    found.add(batch.column("_spans"), batch.column("_items"))
                words, hit = found.counts()
                columns = {c: batch.column(c) for c in plain}
                if hit.any():
                    cut, size = columns[text].to_pylist(), columns[counted].to_pylist() if counted else []
                    spans = found.byte_spans()
                    for d in np.flatnonzero(hit).tolist():
                        raw, at, parts = cut[d].encode(), 0, []
                        for a, b in spans[d]:
                            parts.append(raw[at:a])
                            at = b
                        cut[d] = b"".join([*parts, raw[at:]]).decode()
                        if counted:
                            size[d] = len(cut[d])
                    columns[text] = pa.array(cut, columns[text].type)
                    if counted:
                        columns[counted] = pa.array(size, columns[counted].type)
                out = pa.RecordBatch.from_arrays(list(columns.values()), plain)
                yield out.filter(pa.array(hit <= most_coverage * words))

    schema = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in plain)
    return given.mapInArrow(run, schema).toDF(*names)
