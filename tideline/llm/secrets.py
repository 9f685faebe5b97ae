"""Secret scan with corpus-wide ownership frequency.

Each candidate is reduced to a hash, and the hashes are counted by the distinct repositories and owners
that hold them. A value that many owners hold is a copied example; one that a single owner holds looks
live. Random-looking strings that no fixed rule names are reported only when a single owner holds them; those
of many owners are counted as copied, but have no spans."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialised, text_of
from tideline.llm.flat import LOWER_TABLE, column_slices, flat, runs

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LOOSE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True
_IS_LOOSE = np.zeros(256, bool)
_IS_LOOSE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def looks_random(value: str, bits: float = 3.5) -> bool:
    """Letters of both cases and digits mixed, with much information a character."""
    if not (re.search(r"[0-9].*[0-9].*[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= bits


def candidates(text: str, assign: bool = True, access: bool = True, hexes: bool = True, loose: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of a text, in order: base ones, and loose ones that touch no base one."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if access:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if hexes:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 16]
    base = sorted((a, b) for a, _, b, _ in out)
    if loose:
        k = reach = 0
        for m in LOOSE.finditer(text):
            if len(m[0]) < 20 or not looks_random(m[0]):
                continue
            while k < len(base) and base[k][0] < m.end():
                reach, k = max(reach, base[k][1]), k + 1
            if reach <= m.start():
                out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())]))
    for whole in batches:
        for batch in column_slices(whole, "text"):
            texts = batch.column("text")
            data, offsets = flat(texts)
            flags = []
            #: A loose value of 20 may end in two '=', which are not of the run.
            for inside, least in ((_IS_HEX, 16), (_IS_LOOSE, 18)):
                start, length, first = runs(data, offsets, inside)
                has = np.concatenate([[0], np.cumsum(length >= least)])
                flags.append(np.diff(has[first]) > 0)
            low, found, counts, base = LOWER_TABLE[data].tobytes(), [], [], []
            at = offsets.tolist()
            for k in range(len(texts)):
                piece = low[at[k] : at[k + 1]]
                assign, access = any(x in piece for x in _NAMES), b"akia" in piece
                spans = []
                if assign or access or flags[0][k] or flags[1][k]:
                    spans = candidates(texts[k].as_py(), assign, access, bool(flags[0][k]), bool(flags[1][k]))
                named = [x for x in spans if x[1] < 3]
                counts.append([sum(x[1] == j for x in named) for j in range(3)])
                base.append(hashlib.sha256(",".join(f"{KINDS[j]}:{a}:{b}" for a, j, b, _ in named).encode()).hexdigest())
                found.append([{"start": a, "kind": j, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()} for a, j, b, v in spans])
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("repo"), batch.column("owner"), *(pa.array(n[:, j]) for j in range(3)), pa.array(base, pa.string()), pa.array(found, kind)],
                ["id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_rows, n_repositories, n_owners of candidates (hash, repo, owner); a repository belongs to an
    owner. Counts are made within (hash, owner, repo) first, so that a hash that many rows hold is summed
    before it is shuffled."""
    return (
        found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
        .groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )


def scan_secrets(docs: DataFrame, repo: str, owner: str, id_column: str = "doc_id", text_column: str = "text", copied_from: int = 3) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_owner_specific,
    n_copied. Spans are kind:start:end in code points, by start and then kind; base_sha256 is the hash of the
    base ones. Candidates of `copied_from` owners or more count as copied, loose ones too although they have no
    spans; those of one owner count as specific to it.

    repo and owner are SQL expressions over the row; null ones count as an owner or repository of their own.
    Null and empty texts have no spans; repeated rows each give a row but count once as an owner; a null id
    stays null; extra columns are ignored."""
    kind = docs.schema[id_column].dataType.simpleString()
    given = docs.select(
        docs[id_column].alias("id"), text_of(docs[text_column]).alias("text"),
        F.expr(repo).cast("string").alias("repo"), F.expr(owner).cast("string").alias("owner"),
    )
    scanned = given.mapInArrow(
        _scan,
        f"id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string,"
        "found array<struct<start:long,kind:int,end:long,hash:string>>",
    ).withColumn("row", F.monotonically_increasing_id())
    scanned = materialised(scanned, "secrets")
    found = scanned.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f.*")
    owners = ownership(found)
    shown = (F.col("kind") < KINDS.index("owned")) | (F.col("n_owners") == 1)
    counted = found.join(owners, "hash").where(shown | (F.col("n_owners") >= copied_from))
    spans = F.array_sort(F.collect_list(F.when(shown, F.struct("start", "kind", "end"))))
    by_row = counted.groupBy("row").agg(
        F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",").alias("spans"),
        F.count_if(shown & (F.col("kind") == KINDS.index("owned"))).alias("n_owned"),
        F.count_if(F.col("n_owners") == 1).alias("n_owner_specific"),
        F.count_if(F.col("n_owners") >= copied_from).alias("n_copied"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return scanned.join(by_row, "row", "left").select(
        F.col("id").alias(id_column), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_owned"), zero("n_owner_specific"), zero("n_copied"),
    )
