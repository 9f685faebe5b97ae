"""Near-duplicate groups by MinHash bands with sequential Bayesian verification.

Texts with the same set of word shingles form one class. Classes that agree in a band of their signatures
share a bucket. In each bucket the members are first compared with one pivot; what links is contracted into
components, so that a bucket of thousands of near copies costs one comparison a copy. Members of a bucket
that still lie in different components are compared in blocks of bounded size.

A comparison reads the signatures batch by batch, first the banded values, then the further ones that only
classes in shared buckets have. With a uniform prior, m agreements of n make the similarity
Beta(m + 1, n - m + 1); a pair is dropped as soon as its chance to reach the threshold falls below `miss`.
Pairs that survive are decided on their full sets, which only they are joined with. With 32 bands of 4 values a pair at similarity 0.8 shares
no bucket with a chance of 5e-8."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, text_of
from tideline.llm.components import connected, relabelled
from tideline.llm.flat import LOWER_TABLE, column_slices, flat, hashes, mix, runs

ROWS, BANDS = 4, 32
SIZE = ROWS * BANDS
#: Further values, of 8 bits each; two different ones agree by chance once in 256, which drops no pair.
WIDE = 768
#: Numbers of values compared before each look at the posterior.
LOOKS = (*range(16, SIZE + 1, 16), *range(SIZE + 64, SIZE + WIDE + 1, 64))
_RNG = np.random.default_rng(41)
_TIMES = _RNG.integers(0, 2**31, SIZE + WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, SIZE + WIDE, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; a text of fewer words, but not none,
    has one, of all its words."""
    data, offsets = flat(column)
    start, length, first = runs(data, offsets, _INSIDE)
    (h,) = hashes(LOWER_TABLE[data], start, length)
    g, n = h.copy(), len(h)
    for j in range(1, min(words, n + 1)):
        behind = np.zeros_like(h)
        behind[: n - j] = h[j:]
        g = mix(g * _STEP + behind)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(g[a : b - words + 1]))
        elif b > a:
            raw = hashlib.blake2b(h[a:b].tobytes(), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(raw, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], wide: bool = False, block: int = 50_000) -> np.ndarray:
    """A row for each set, none of which is empty: low bits of the least of its shingles under each of SIZE
    orders (16 bits) or, for the wide part, of WIDE further ones (8 bits)."""
    orders = range(SIZE, SIZE + WIDE) if wide else range(SIZE)
    kind = np.uint8 if wide else np.uint16
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(count)
    value = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, np.uint32)
    out, i = np.zeros((len(sets), len(orders)), kind), 0
    while i < len(sets):
        at = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, at + block, side="right")))
        part, begins = value[at : int(ends[j - 1])], ends[i:j] - count[i:j] - at
        for c, k in enumerate(orders):
            out[i:j, c] = np.minimum.reduceat((part ^ _FLIP[k]) * _TIMES[k], begins).astype(kind)
        i = j
    return out


@cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each look: the fewest agreements at which the chance that the similarity reaches the threshold is
    `miss` or more. That chance, of the Beta posterior, is the one that at most m of n + 1 draws at the threshold
    succeed."""
    out = []
    for n in LOOKS:
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def likely(left: list[np.ndarray], right: list[np.ndarray], threshold: float, miss: float) -> np.ndarray:
    """Places of the row pairs that no look at the posterior drops; each side has banded and maybe wide values."""
    alive, agree, done = np.arange(len(left[0])), np.zeros(len(left[0]), np.int64), 0
    for upto, least in zip(LOOKS, least_matches(threshold, miss)):
        if not len(alive) or (upto > SIZE and len(left) == 1):
            break
        which, before = (0, 0) if upto <= SIZE else (1, SIZE)
        part = slice(done - before, upto - before)
        agree = agree + (left[which][alive, part] == right[which][alive, part]).sum(1)
        going = agree >= least
        alive, agree, done = alive[going], agree[going], upto
    return alive


def _similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _matrix(column: pa.Array, kind: type = np.uint16, size: int = SIZE) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), size) if raw else np.zeros((0, size), kind)


def _wide(column: pa.Array) -> np.ndarray:
    return _matrix(column, np.uint8, WIDE)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signed(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """id, key (digest of the set; null if it is empty), n, signature of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                some = iter(signatures([x for x in sets if len(x)]))
                sign = [next(some).tobytes() if len(x) else None for x in sets]
                keys = pa.array(map(_digest, sets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), keys, pa.array(map(len, sets), pa.int64()), pa.array(sign, pa.binary())], ["id", "key", "n", "signature"])

    given = docs.select(docs[id_column].alias("id"), text_of(docs[text_column]).alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, key binary, n long, signature binary")


def _full_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, n, signature, wide, shingles of the wanted classes (cid, key, id, signature). Rows that share an id
    are told apart by their keys. A task gives a class once; that several do changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for whole in batches:
            for batch in column_slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                rows = []
                for k, (cid, key) in enumerate(zip(batch.column("cid").to_pylist(), batch.column("key").to_pylist())):
                    if cid not in given and _digest(sets[k]) == key:
                        given.add(cid)
                        rows.append(k)
                sets, some = [sets[k] for k in rows], pa.array(rows, pa.int64())
                wide = signatures(sets, wide=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid").take(some), pa.array(map(len, sets), pa.int64()), batch.column("signature").take(some), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["cid", "n", "signature", "wide", "shingles"],
                )

    mine = wanted.select(F.col("id").alias("own"), "cid", "key", "signature")
    found = texts.join(mine, F.col("id").eqNullSafe(F.col("own"))).select(text_of("text").alias("text"), "cid", "key", "signature")
    return found.mapInArrow(run, "cid long, n long, signature binary, wide binary, shingles binary")


def _bucketed(classes: DataFrame) -> DataFrame:
    """band, bucket, cid: a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _matrix(batch.column("signature")).view(np.int64)
            cid = np.repeat(batch.column("cid").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(bucket.ravel()), pa.array(cid)], ["band", "bucket", "cid"])

    return classes.select("cid", "signature").mapInArrow(run, "band int, bucket long, cid long")


def _beside(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both classes."""
    side = lambda x: rows.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def _kept(batch: pa.RecordBatch, alive: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in "ab"], ["a", "b"])


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that the looks at the banded values do not drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            alive = np.flatnonzero(100 * np.minimum(*n) >= percent * np.maximum(*n))
            left, right = ([_matrix(batch.column(f"signature_{x}"))[alive]] for x in "ab")
            yield _kept(batch, alive[likely(left, right, percent / 100, miss)])

    return _beside(pairs, classes, "n", "signature").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
                alive = np.flatnonzero(100 * np.minimum(*n) >= percent * np.maximum(*n))
                one, two = batch.column("shingles_a"), batch.column("shingles_b")
                common = [len(np.intersect1d(np.frombuffer(one[k].as_py(), np.uint64), np.frombuffer(two[k].as_py(), np.uint64), assume_unique=True)) for k in alive.tolist()]
                yield _kept(batch, alive[_similar(np.array(common, np.int64), n[0][alive], n[1][alive], percent)])

    return _beside(pairs, sets, "n", "shingles").mapInArrow(run, "a long, b long")


def _survivors(members: DataFrame, percent: int, miss: float, best: bool) -> DataFrame:
    """Pairs of members (band, bucket, i, j, cid, comp, n, signature, wide, own) of each block pair that lie in
    different components and that their signatures do not rule out; a pair counts in its first common band. With `best`, of each two
    components that meet in a block pair the two members that agree most."""

    def pairs_of(group: dict[str, np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray]:
        n, sign, comp = group["n"], group["signature"], group["comp"]
        values = [group["signature"], group["wide"]]
        left = np.flatnonzero(group["own"] & 1)
        right = np.flatnonzero(group["own"] & 2)
        out = []
        order = right[np.argsort(n[right], kind="stable")]
        sizes = n[order]
        for x in left.tolist():
            lo = np.searchsorted(sizes, -(-percent * n[x] // 100))
            hi = np.searchsorted(sizes, 100 * n[x] // percent, side="right")
            y = order[lo:hi]
            y = y[comp[y] != comp[x]]
            if group["same"]:
                y = y[group["cid"][y] > group["cid"][x]]
            if not len(y):
                continue
            bands = sign[y].view(np.int64) == sign[x].view(np.int64)
            y = y[bands.argmax(1) == band]
            mine = [np.broadcast_to(z[x], (len(y), z.shape[1])) for z in values]
            y = y[likely(mine, [z[y] for z in values], percent / 100, miss)]
            agree = (sign[y] == sign[x]).sum(1)
            out.append((np.full(len(y), x), y, agree))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y, agree = (np.concatenate(z) for z in zip(*out))
        if best and len(x):
            low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
            order = np.lexsort((-agree, high, low))
            first = np.diff(low[order], prepend=low[order[0]] - 1).astype(bool) | np.diff(high[order], prepend=high[order[0]] - 1).astype(bool)
            x, y = x[order[first]], y[order[first]]
        return group["cid"][x], group["cid"][y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            key = np.stack([rows.column(c).to_numpy() for c in ("band", "bucket", "i", "j")], 1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            own = {c: rows.column(c).to_numpy() for c in ("cid", "comp", "n", "own")}
            own["signature"], own["wide"] = _matrix(rows.column("signature")), _wide(rows.column("wide"))
            found = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), rows.num_rows]):
                if b - a > 1:
                    group = {c: v[a:b] for c, v in own.items()} | {"same": key[a, 2] == key[a, 3]}
                    found.append(pairs_of(group, int(key[a, 0])))
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            #: All but the last group, which may go on in the next batch; a block pair has a bounded size.
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 4096:
                continue
            key = [rows.column(c).to_numpy() for c in ("band", "bucket", "i", "j")]
            ends = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield done(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return members.mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, sets: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """The members of buckets that hold several components yet, dealt to pairs of blocks of about `block`."""
    placed = relabelled(members, labels, "cid", "comp")
    open_buckets = placed.groupBy("band", "bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("band", "bucket")
    left = placed.join(open_buckets, ["band", "bucket"]).join(sets.select("cid", "n", "signature", "wide"), "cid")
    left = left.withColumn("blocks", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    left = left.withColumn("at", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = left.select(
        "band", "bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "cid", "comp", "n", "signature", "wide",
        #: 1: on the left side of its block pair, 2: on the right, 3: on both.
        F.when(F.col("at") == F.col("other"), 3).when(F.col("at") < F.col("other"), 1).otherwise(2).alias("own"),
    )
    return dealt.repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-5, block: int = 512) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that is reachable by links, its
    own included), kept (the id is the component's).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct runs of
    `words` words. Two texts are linked when 100 * |common| >= percent * |union|. Null, empty and blank texts
    have an empty set and are linked with nothing. Rows with the same set are one class, however many they
    are. A null id is larger than any other: it is a component's id only where no row has one. Rows that
    share an id share its fate. Extra columns are ignored."""
    work = Scratch(docs.sparkSession)
    rows = work.keep(_signed(docs, id_column, text_column, words), "near-rows")
    classes = work.keep(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "near-classes",
    )
    places = _bucketed(classes)
    shared = places.groupBy("band", "bucket").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = work.keep(places.join(shared, ["band", "bucket"]), "near-members")

    #: The full sets of classes that share a bucket, from the text of one of their rows.
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    sets = work.keep(_full_sets(texts, wanted, words), "near-sets")

    pairs = members.where("cid != pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    likely_ones = work.keep(_pruned(pairs, classes, percent, miss), "near-pairs")
    labels = connected(work.keep(_verified(likely_ones, sets, percent), "near-links"), "near-first")

    #: First the likeliest pair of each two components, which joins most that belong together, then all others.
    for best in (True, False):
        pairs = work.keep(_survivors(_blocks(members, sets, labels, block), percent, miss, best).distinct(), "near-pairs")
        more = work.keep(_verified(pairs, sets, percent), "near-links")
        over = relabelled(relabelled(more, labels, "a", "x"), labels, "b", "y").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        merged = connected(over, "near-merged")
        moved = relabelled(labels.select("node", F.col("comp").alias("old")), merged, "old", "comp").select("node", "comp")
        labels = work.keep(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti").select("node", "comp")), "near-labels")
    final = relabelled(classes.select("cid", "key", "id"), labels, "cid", "comp")
    final = work.keep(final.select("cid", "key", "id", "comp"), "near-final")
    work.drop("near-members", "near-sets", "near-pairs", "near-links", "near-labels", "near-classes")
    ids = final.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    #: Components of one class need no row of their own.
    wide = ids.where("classes > 1").select("comp", "component_id")
    known = final.join(wide, "comp", "left").select("key", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = rows.select("id", "n", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs with one document of each group: rows whose id is not their component's go. Rows without an id stay,
    since nothing names them."""
    dropped = near_groups(docs, id_column, text_column, **options).where("NOT kept").select(F.col(id_column).alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_column] == F.col("_dropped"), "left_anti")
