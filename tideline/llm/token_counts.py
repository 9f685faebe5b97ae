"""Token counts by overlap resynchronisation.

A text longer than a chunk is encoded in chunks that overlap. A place where a unit begins (white space behind
something else) in both of two neighbouring chunks begins one in the whole text, too, and no token spans it: all
that is left of it is whole in the left chunk, and from there on the right chunk reads what the whole text
holds. The counts are spliced there. Where the overlap has no such place it is doubled until it has one, at the
latest at the text's end. Texts of one chunk have nothing to splice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import text_of
from tideline.llm.flat import column_slices
from tideline.llm.library_tokens import encoder
from tideline.llm.units import UnitTable


def _encoded(texts: list[bytes], pairs: list[tuple[int, int, int]], units: UnitTable) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For chunks (text, begin, end) the places in the text where units begin, the chunk's tokens before each, and
    all its tokens."""
    starts, before, offsets = units.boundaries(pa.array([texts[t][a:b].decode() for t, a, b in pairs], pa.string()))
    first = np.searchsorted(starts, offsets).tolist()
    return [(starts[i:j] - at + a, before[i:j] - before[i], int(before[j] - before[i])) for (_, a, _), at, i, j in zip(pairs, offsets.tolist(), first, first[1:])]


def _at_letter(raw: bytes, at: int) -> int:
    """The place, or the one before it where a character begins."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(raw))


def spliced_counts(texts: list[bytes], units: UnitTable, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(tokens, splices, times that an overlap was widened) of each text."""
    if overlap < 8 or chunk <= overlap:
        raise ValueError("overlap must be 8 or more and chunk over overlap")
    pairs = []
    for t, raw in enumerate(texts):
        bounds = [_at_letter(raw, a) for a in range(0, len(raw), chunk)]
        pairs += [(t, a, _at_letter(raw, a + chunk + overlap)) for a in bounds]
    encoded = iter(_encoded(texts, pairs, units)) if pairs else iter(())
    total, splices, widened = ([0] * len(texts) for _ in range(3))
    left: dict[int, tuple] = {}  # text: (encoded, begin, end, tokens of it that are already counted)
    for (t, a, b), own in zip(pairs, encoded):
        if t not in left:
            left[t] = own, a, b, 0
            continue
        while True:
            (at, count, _), begin, end, done = left[t]
            if end >= len(texts[t]):
                break  # the left chunk reads to the end: what follows is within it
            _, i, j = np.intersect1d(at, own[0], assume_unique=True, return_indices=True)
            ahead = count[i] >= done
            if ahead.any():
                x = int(np.argmax(ahead))
                total[t] += int(count[i[x]]) - done
                splices[t] += 1
                left[t] = own, a, b, int(own[1][j[x]])
                break
            widened[t] += 1
            wider = _at_letter(texts[t], a + 2 * (end - a))
            left[t] = _encoded(texts, [(t, begin, wider)], units)[0], begin, wider, done
    for t, (own, _, _, done) in left.items():
        total[t] += own[2] - done
    return list(zip(total, splices, widened))


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512, chunk: int = 4096, overlap: int = 256) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_splices,
    n_widened. Texts over `chunk` bytes are counted chunk by chunk, however long they are.

    Null and empty texts have no tokens; special strings inside texts count as the library's default has it.
    A null id stays null, repeated rows each give a row, no rows give none, extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, units = encoder(path)
        for whole in batches:
            for batch in column_slices(whole, "text"):
                size = batch.column("n_bytes").to_numpy(zero_copy_only=False)
                long = size > chunk
                tokens = np.zeros((3, len(size)), np.int64)
                if not long.all():
                    _, ends = units.encode(batch.column("text").filter(pa.array(~long)))
                    tokens[0, ~long] = np.diff(ends)
                if long.any():
                    texts = [x.encode() for x in batch.column("text").filter(pa.array(long)).to_pylist()]
                    tokens[:, long] = np.array(spliced_counts(texts, units, chunk, overlap)).T
                columns = [batch.column("id"), batch.column("n_bytes"), *(pa.array(x) for x in tokens)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "n_splices", "n_widened"])

    kind = docs.schema[id_column].dataType.simpleString()
    text = text_of(docs[text_column])
    given = docs.select(docs[id_column].alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = given.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, n_splices long, n_widened long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_splices", "n_widened")
