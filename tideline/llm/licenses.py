"""License scan by an exact set-similarity join.

Every line of a text is a block, a set of words; every template is a set of words. A block matches a template
when it holds at least `containment` of the template's words. Words are ordered by how many blocks of the
corpus hold them, rare ones first. A template of n words that needs m in common can spare n - m, so each
matching block holds one of its n - m + 1 rarest words (prefix filter), has m words or more (length filter),
and at the place of the first common word enough words must be left on both sides (positional filter).
Pairs that pass are counted in full, so no match is lost.

Notices are often wrapped, so windows of words that run over line ends are blocks, too: for a template of L
words all runs of ceil(L / containment) words of a text. Comment marks are no words and do not count. The
prefix and length filters pick the windows that are counted in full."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORDS, text_of
from tideline.llm.flat import column_slices, flat, hashes, runs
from tideline.llm.decontaminate import _FOLD, _INSIDE

#: Phrases and their labels.
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Sentences by which files state a license, and their labels.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Released under the MIT License",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0",),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited",),
}


def _template_words(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(t.encode().translate(WORDS).split())) for label, texts in templates.items() for t in texts]


def _hash_of(words: list[bytes]) -> np.ndarray:
    length = np.fromiter(map(len, words), np.int64, len(words))
    return hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)[0]


class _Blocks:
    """The words of a batch and the lines they stand in."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat(column)
        self.start, self.length, self.first = runs(self.data, self.offsets, _INSIDE)
        (self.hash,) = hashes(_FOLD[self.data], self.start, self.length)
        #: A new block begins after each line end and at each text.
        edges = np.unique(np.concatenate([np.flatnonzero(self.data == 10), self.offsets[:-1]]))
        self.block = np.searchsorted(edges, self.start, side="right")

    def known(self, sorted_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are in sorted_hash, their numbers there)."""
        at = np.minimum(np.searchsorted(sorted_hash, self.hash), len(sorted_hash) - 1)
        place = np.flatnonzero(sorted_hash[at] == self.hash)
        return place, at[place]


def word_frequencies(docs: DataFrame, words: list[bytes], text_column: str = "text") -> dict[bytes, int]:
    """For each of the templates' words the number of blocks that hold it, over the whole corpus. Counts are
    summed within a task before the shuffle; the result has one row for each of the given words."""
    value = _hash_of(words)
    order = np.argsort(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for whole in batches:
            for batch in column_slices(whole, "text"):
                blocks = _Blocks(batch.column("text"))
                place, number = blocks.known(value[order])
                pairs = np.unique(blocks.block[place] * np.int64(len(words)) + order[number])
                total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], ["word", "n"])

    counted = docs.select(text_of(docs[text_column]).alias("text")).mapInArrow(run, "word long, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {words[r["word"]]: r["n"] for r in rows}
    return {w: found.get(w, 0) for w in words}


class PrefixJoin:
    """Blocks against templates; words are numbered by frequency, rare ones first."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], lengths: list[int], frequency: dict[bytes, int], containment: float):
        order = {w: k for k, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.templates = [(label, sorted(order[w] for w in words)) for label, words in templates]
        self.needed = [math.ceil(containment * len(words) - 1e-9) for _, words in self.templates]
        self.window = [math.ceil(n / containment - 1e-9) for n in lengths]
        self.member = np.zeros((len(self.templates), len(order)), bool)
        self.rare = np.zeros((len(self.templates), len(order)), bool)
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, words) in enumerate(self.templates):
            self.member[t, words] = True
            self.rare[t, words[: len(words) - self.needed[t] + 1]] = True
            for at, w in enumerate(words[: len(words) - self.needed[t] + 1]):
                self.prefix.setdefault(w, []).append((t, at))
        words = list(order)
        value = _hash_of(words)
        by = np.argsort(value)
        self.hash, self.number = value[by], np.array([order[w] for w in words])[by]
        self.in_prefix = np.zeros(len(order), bool)
        self.in_prefix[list(self.prefix)] = True

    def matches(self, block: list[int], size: int) -> dict[int, float]:
        """template -> containment of a block, given the numbers of its template words in order, and its size
        with all its distinct words."""
        tried: set[int] = set()
        out = {}
        for i, w in enumerate(block):
            for t, at in self.prefix.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)
                words, need = self.templates[t][1], self.needed[t]
                if size < need or 1 + min(len(block) - i - 1, len(words) - at - 1) < need:
                    continue
                common = len(set(words).intersection(block[i:]))
                if common >= need:
                    out[t] = common / len(words)
        return out

    def wrapped(self, b: _Blocks, place: np.ndarray, number: np.ndarray, lines: list[set[int]]) -> Iterator[tuple[int, int, float, tuple[int, int] | None]]:
        """(place, template, containment, passage) of the windows over line ends that match, given the places and
        numbers of the templates' words and the lines that match each template. The passage goes from the first
        to the last of the template's words in no such line, if those words alone match."""
        for t, need in enumerate(self.needed):
            rare = place[self.rare[t][number]]
            if not len(rare):
                continue
            mine = self.member[t][number]
            at, word = place[mine], number[mine]
            stop = np.minimum(at + self.window[t], b.first[np.searchsorted(b.first, at, side="right")])
            end, i = np.searchsorted(at, stop), np.arange(len(at))
            next_rare = rare[np.minimum(np.searchsorted(rare, at), len(rare) - 1)]
            open_ones = (end - i >= need) & (next_rare >= at) & (next_rare < stop) & (b.block[at[end - 1]] != b.block[at])
            for lo, hi in zip(np.flatnonzero(open_ones).tolist(), end[open_ones].tolist()):
                if (common := len(set(word[lo:hi].tolist()))) < need:
                    continue
                rest = [k for k in range(lo, hi) if int(b.block[at[k]]) not in lines[t]]
                whole = len({int(word[k]) for k in rest}) >= need
                yield int(at[lo]), t, common / len(self.templates[t][1]), (int(at[rest[0]]), int(at[rest[-1]])) if whole else None


def _phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES.items():
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", containment: float = 0.9, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row per input row: id, n_words, n_base (places of the phrases), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (distinct, sorted, comma-joined), score (the
    largest containment; 1 where a phrase stands), n_blocks (matching lines and passages). A passage is a run
    of overlapping windows over line ends that match a template without the lines that match it themselves.

    Null and empty texts have no words and score 0; blocks that repeat match each time; a null id stays null,
    repeated rows each give a row; extra columns are ignored."""
    cut = _template_words(templates)
    frequency = word_frequencies(docs, sorted({w for _, words in cut for w in words}), text_column)
    lengths = [len(t.encode().translate(WORDS).split()) for texts in templates.values() for t in texts]
    join = PrefixJoin(cut, lengths, frequency, containment)
    last_words = _hash_of([b"license"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, "text"):
                n = batch.num_rows
                b = _Blocks(batch.column("text"))
                place, at = b.known(join.hash)
                number = join.number[at]
                every = place, number
                #: Only blocks that hold a prefix word and enough of the templates' words.
                open_blocks = np.unique(b.block[place][join.in_prefix[number]])
                mine = np.isin(b.block[place], open_blocks)
                place, number = place[mine], number[mine]
                pairs = np.unique(b.block[place] * np.int64(1 << 20) + number)
                block, word = pairs >> 20, pairs & ((1 << 20) - 1)
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                least = min(join.needed, default=1)
                labels: list[set] = [set() for _ in range(n)]
                score, matched = np.zeros(n), np.zeros(n, np.int64)
                lines: list[set[int]] = [set() for _ in join.templates]
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs)]):
                    if hi - lo < least:
                        continue
                    first = int(np.searchsorted(b.block, block[lo]))
                    last = int(np.searchsorted(b.block, block[lo], side="right"))
                    if found := join.matches(word[lo:hi].tolist(), len(np.unique(b.hash[first:last]))):
                        d = int(np.searchsorted(b.first, first, side="right")) - 1
                        labels[d].update(join.templates[t][0] for t in found)
                        score[d] = max(score[d], *found.values())
                        matched[d] += 1
                        for t in found:
                            lines[t].add(int(block[lo]))
                passages = []
                for where, t, value, passage in join.wrapped(b, *every, lines):
                    d = int(np.searchsorted(b.first, where, side="right")) - 1
                    labels[d].add(join.templates[t][0])
                    score[d] = max(score[d], value)
                    passages += [(*passage, d)] if passage else []
                reach = -1
                for first, last, d in sorted(passages):
                    matched[d] += first > reach
                    reach = max(reach, last)
                base: list[list] = [[] for _ in range(n)]
                ends = np.unique(np.searchsorted(b.first, np.flatnonzero(b.hash == last_words[0]), side="right") - 1)
                for d in ends.tolist():
                    base[d] = _phrase_places(b.data[b.offsets[d] : b.offsets[d + 1]].tobytes().translate(WORDS).split())
                join_up = lambda x: ",".join(sorted(set(x)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), pa.array(np.diff(b.first), pa.int64()), pa.array(map(len, base), pa.int64()),
                        pa.array([min(x)[0] if x else None for x in base], pa.int64()), pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                        pa.array([join_up(l for _, l in x) for x in base], pa.string()), pa.array([join_up({l for _, l in x} | y) for x, y in zip(base, labels)], pa.string()),
                        pa.array([1.0 if x else float(s) for x, s in zip(base, score)], pa.float64()), pa.array(matched),
                    ],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(docs[id_column].alias("id"), text_of(docs[text_column]).alias("text"))
    out = given.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")
    return out.withColumnRenamed("id", id_column)
