"""Token ids of a tokenizers file (byte-level BPE), with the library doing each distinct word once."""

from __future__ import annotations

import json
import os

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers
from tokenizers.processors import ByteLevel as ByteOffsets

from tideline.llm.flat import ranges
from tideline.llm.units import WHITE, UnitTable, wide_white_ends

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_LETTER, _DIGIT, _MARK = 1, 2, 3


def _byte_letters() -> list[bytes]:
    """The letter, in UTF-8, that stands for each byte in a byte-level vocabulary: printable bytes of Latin-1 for
    themselves, the others, in order, as the letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)).encode() for b in range(256)]


class LibraryEncoder:
    """Encodes units, which keep their ids wherever they stand. They are joined to long texts that the library
    encodes at once; the byte lengths of the tokens tell where each unit ends.

    Most units are plain: letters, digits and marks, maybe after one white space character. Their words are known
    without the library's own search (they end where the kind of character changes), so that only its merges are
    needed; that holds for the common byte-level pattern and for no other, which the file tells."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Offsets with the leading spaces; the ids stay the same.
        self.tokenizer.post_processor = ByteOffsets(trim_offsets=False)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.longest_special = max(map(len, self.special), default=0)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            #: Each letter of a token stands for a byte; special ones are plain text.
            self.size[i] = len(token.encode()) if token in self.special else len(token)
        self.kind = np.where(_LETTERS, _LETTER, 0).astype(np.uint8)
        self.kind[48:58] = _DIGIT
        self.kind[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'" + "".join(self.special)]] = _MARK
        split = json.loads(self.tokenizer.to_str())
        first = split["pre_tokenizer"] or {}
        known = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not split["normalizer"]
        self.merges = None
        if known and all((self.kind[np.frombuffer(s.encode(), np.uint8)] == 0).any() for s in self.special):
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = [*_byte_letters(), b" "]
        self.letter_size = np.array([len(x) for x in letters])
        self.letter_start = np.cumsum(self.letter_size) - self.letter_size
        self.letters = np.frombuffer(b"".join(letters), np.uint8)

    def _ids(self, texts: list[str], by: Tokenizer | None = None) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of each byte, 0 for none; letters of two bytes up to U+017F are letters."""
        kind = self.kind[data]
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
        lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
        kind[lead] = kind[lead + 1] = _LETTER
        return kind

    def _plain_ids(self, got: np.ndarray, kind: np.ndarray, begins: np.ndarray, piece: int) -> np.ndarray:
        """Ids of plain units, given as bytes one after another, where each begins."""
        cut = np.zeros(len(got), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (got[:-1] != 32)
        cut[begins] = True
        word = np.flatnonzero(cut)
        spelled = np.insert(got.astype(np.int64), word[1:], 256)
        size = self.letter_size[spelled]
        text = self.letters[ranges(self.letter_start[spelled], size)]
        #: Where each piece of units begins in the spelled text, after its separator.
        at = begins[::piece]
        at = (np.cumsum(size) - size)[at + np.searchsorted(word, at)].tolist()
        return np.concatenate(self._ids([text[a:b].tobytes().decode() for a, b in zip(at, [*at[1:], len(text)])], self.merges))

    def encode_units(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, piece: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, all ids) of texts that are split alone as they are within a longer text. A unit that is
        not plain joins others if it begins with white space and ends with something else, as then no match spans
        the seam."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        kind = self._kinds(data)
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        led = np.isin(data[starts], (9, 10, 32))
        plain = (odd[starts + lengths] - odd[starts] == led) & (lengths > led) & (self.merges is not None)
        ends = starts + lengths - 1
        open_end = (data[ends] <= 32) | ((data[ends] >= 128) & wide_white_ends(data)[ends])
        joins = ~plain & WHITE[data[starts]] & ~open_end
        first, second = int(plain.sum()), int(joins.sum())
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(joins), np.flatnonzero(~plain & ~joins)])
        lengths = lengths[order]
        places = ranges(starts[order], lengths)
        got, ends = data[places], np.cumsum(lengths)
        begins = ends - lengths
        parts = []
        if first:
            part = slice(0, int(ends[first - 1]))
            parts.append(self._plain_ids(got[part], kind[places[part]], begins[:first], piece))
        #: Which units make each other text: `piece` of those that join, and any other one alone.
        bounds = np.concatenate([np.arange(first, first + second, piece), np.arange(first + second, len(order) + 1)])
        at = np.concatenate([[0], ends])[bounds].tolist()
        parts += self._ids([got[a:b].tobytes().decode() for a, b in zip(at, at[1:])])
        joined = first + second
        ids, groups = np.concatenate(parts), len(parts) - (len(order) - joined)
        together = sum(map(len, parts[:groups]))
        upto = np.cumsum(self.size[ids[:together]])
        seam = np.searchsorted(upto, ends[:joined])
        if joined and (seam[-1] >= together or (upto[seam] != ends[:joined]).any()):
            raise ValueError("tokens span a seam of joined units")
        count = np.zeros(len(order), np.int64)
        count[order] = np.concatenate([np.diff(seam + 1, prepend=0), np.fromiter(map(len, parts[groups:]), np.int64, len(parts) - groups)])
        begin = np.zeros(len(order), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return count, ids[ranges(begin, count)]


_ENCODERS: dict[str, tuple[LibraryEncoder, UnitTable]] = {}


def encoder(path: str) -> tuple[LibraryEncoder, UnitTable]:
    """One per Python worker and file, kept from task to task."""
    if path not in _ENCODERS:
        own = LibraryEncoder(path)
        _ENCODERS[path] = own, UnitTable(own.encode_units)
    return _ENCODERS[path]
