"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks at places that its content decides, so
that equal passages give equal chunks. A chunk's address is the SHA-256 of its ids; each is stored once. A
document's recipe lists the addresses and lengths of its chunks; recipes lie in ascending id order. The Merkle
root of a recipe stands for its document, each recipe partition has the root of its documents' roots, and the
dataset has one root above all. Reading checks every level; what is missing or altered is an error.

Layout below the folder: staged/kind=chunk (address, ids compressed), recipes/kind=0 (documents), recipes/kind=1
(one row for each recipe partition: its root and totals), dataset (the root above, partitions, ids)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import materialised, shared_dir, text_of
from tideline.llm.flat import column_slices
from tideline.llm.library_tokens import encoder

WINDOW = 16
_GEAR = np.random.default_rng(7).integers(0, 2**64, size=1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray, starts: np.ndarray, least: int = 128, mean: int = 512, most: int = 4096) -> np.ndarray:
    """Ends of the chunks of documents that follow one another in ids; each starts at one of starts. A chunk
    ends where the hash of its last WINDOW ids has its low bits clear, or at `most` ids; a chunk under `least`
    ids only ends with its document. least must be at least WINDOW, so that no hash reads another document."""
    if least < WINDOW or mean & (mean - 1):
        raise ValueError(f"least must be {WINDOW} or more and mean a power of two")
    h = _GEAR[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint64(step) if len(h) > step else 0
        h, step = more, 2 * step
    places = np.flatnonzero((h >> np.uint64(20)) & np.uint64(mean - 1) == 0) + 1
    out, k, places = [], 0, places.tolist()
    bounds = [*starts.tolist(), len(ids)]
    for begin, end in zip(bounds, bounds[1:]):
        while begin < end:
            while k < len(places) and places[k] < begin + least:
                k += 1
            at = min(places[k] if k < len(places) else end, begin + most, end)
            out.append(at)
            begin = at
    return np.array(out, np.int64)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves in order; a last one without a partner moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])] + level[len(level) - len(level) % 2 :]
    return level[0]


def _leaves(addresses: list[bytes], sizes: bytes) -> list[bytes]:
    """The leaves of a recipe: address and length of each chunk."""
    return [x + sizes[4 * k : 4 * k + 4] for k, x in enumerate(addresses)]


def _split(blob: bytes) -> list[bytes]:
    return [blob[i : i + 32] for i in range(0, len(blob), 32)]


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode the texts, append end_id to each, and write the store. Null and empty texts hold the end id
    only, very long ones are many chunks; null ids come first; repeated rows each have a recipe; extra columns
    are ignored."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["key", "data", "sizes", "id", "n"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: set[bytes] = set()
        for whole in batches:
            for batch in column_slices(whole, "text"):
                ids, ends = table.encode(batch.column("text"))
                n = batch.num_rows
                where = ends[1:] + np.arange(n)
                full = np.insert(ids, ends[1:], end_id)
                starts = np.concatenate([[0], where[:-1] + 1]) if n else where
                last = cuts(full, starts)
                first = np.concatenate([[0], last[:-1]])
                raw = full.astype("<u4").tobytes()
                addresses = [hashlib.sha256(raw[4 * a : 4 * b]).digest() for a, b in zip(first.tolist(), last.tolist())]
                fresh = []
                for c, address in enumerate(addresses):
                    if address not in seen:
                        seen.add(address)
                        fresh.append(c)
                if len(seen) > 200_000:  # spares the shuffle most copies; the rest meet behind it
                    seen.clear()
                small = full.astype("<u2") if int(full.max(initial=0)) < 65536 else full.astype("<u4")
                data = [pack(bytes([small.itemsize]) + small[first[c] : last[c]].tobytes()) for c in fresh]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([addresses[c] for c in fresh], pa.binary()), pa.array(data, pa.binary()), pa.nulls(len(fresh), pa.binary()),
                        pa.nulls(len(fresh), batch.column("id").type), pa.array(last[fresh] - first[fresh], pa.int64()),
                    ],
                    names,
                )
                upto = np.searchsorted(first, [*starts.tolist(), len(full)]).tolist()
                length = (last - first).astype("<u4").tobytes()
                lists = [(addresses[a:b], length[4 * a : 4 * b]) for a, b in zip(upto, upto[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([merkle(_leaves(*x)) for x in lists], pa.binary()), pa.array([b"".join(x) for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary()),
                        batch.column("id"), pa.array(np.diff([*starts, len(full)]), pa.int64()),
                    ],
                    names,
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their keys; of chunks with the same the first stays."""
        last = None
        for batch in batches:
            if batch.num_rows:
                key, chunk = batch.column("key"), batch.column("sizes").is_null()
                before = pa.concat_arrays([pa.array([last], pa.binary()), key.slice(0, batch.num_rows - 1)])
                again = pc.fill_null(pc.equal(key, before), False)
                last = key[-1].as_py() if chunk[-1].as_py() else None
                yield batch.filter(pc.invert(pc.and_(again, chunk)))

    row = f"key binary, data binary, sizes binary, id {kind}, n long"
    given = docs.select(docs[id_column].alias("id"), text_of(docs[text_column]).alias("text"))
    #: Chunks meet by address; a recipe goes by its root and a salt, since many documents may share a root.
    encoded = given.mapInArrow(encode, row)
    dealt = encoded.repartition(F.col("key"), F.when(F.col("sizes").isNotNull(), F.xxhash64("id"))).sortWithinPartitions(F.col("sizes").isNull(), "key")
    staged = dealt.mapInArrow(once, row).withColumn("kind", F.when(F.col("sizes").isNotNull(), "recipe").otherwise("chunk"))
    staged.write.mode("overwrite").option("compression", "none").partitionBy("kind").parquet(f"{folder}/staged")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, roots, level = TaskContext.get().partitionId(), 0, [], None
        columns = ["part", "start", "id", "n", "root", "chunks", "sizes", "kind"]
        for batch in batches:
            n = batch.column("n").to_numpy()
            roots += [hashlib.sha256(x).digest() for x in batch.column("key").to_pylist()]
            level = batch.column("id").type
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part)), pa.array(begin), *(batch.column(c) for c in ("id", "n", "key", "data", "sizes")), pa.array(np.zeros(k, np.int32))], columns)
        if roots:
            blank = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([0]), pa.nulls(1, level), pa.array([at]), pa.array([merkle(roots)], pa.binary()), blank, blank, pa.array([1], pa.int32())], columns)

    recipes = spark.read.schema(row).parquet(f"{folder}/staged/kind=recipe") if _exists(spark, f"{folder}/staged/kind=recipe") else spark.createDataFrame([], row)
    ordered = recipes.select("id", "key", "n", "data", "sizes").repartitionByRange("id").sortWithinPartitions("id", "key")
    schema = f"part long, start long, id {kind}, n long, root binary, chunks binary, sizes binary, kind int"
    ordered.mapInArrow(order, schema).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/recipes")
    parts = manifest(spark, folder).orderBy("part").collect()
    spark.createDataFrame([(bytearray.fromhex(_above(parts)), len(parts), sum(r["n"] for r in parts))], "root binary, parts long, n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dataset")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _unpacked(address: bytes, data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ids = np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")
    if hashlib.sha256(ids.tobytes()).digest() != address:
        raise ValueError(f"chunk {address.hex()} does not match its address")
    return ids


def _crc_tables() -> np.ndarray:
    """tables[k][j][b]: what byte j with value b of a CRC-32 becomes after 2**k zero bytes."""
    shift = lambda crc: (crc >> 8) ^ _BYTE[crc & 255]
    one = np.zeros((4, 256), np.uint32)
    for j in range(4):
        one[j] = shift(np.arange(256, dtype=np.uint32) << np.uint32(8 * j))
    out = [one]
    for _ in range(39):
        out.append(np.stack([_apply(out[-1], out[-1][j]) for j in range(4)]))
    return np.stack(out)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _byte_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> np.uint32(1) ^ np.uint32(0xEDB88320), value >> np.uint32(1)).astype(np.uint32)
    return value


_BYTE = _byte_table()
_SHIFTS = _crc_tables()


def crc_before(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to the CRC-32 of a text in which `behind` more bytes follow; the whole text's
    CRC-32 is the exclusive or of what its parts add."""
    crc, behind, k = crc.astype(np.uint32), behind.astype(np.int64), 0
    while behind.any():
        odd = (behind & 1).astype(bool)
        crc = np.where(odd, _apply(_SHIFTS[k], crc), crc)
        behind, k = behind >> 1, k + 1
    return crc


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    path, schema = f"{folder}/staged/kind=chunk", "key binary, data binary, n long"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _recipes(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Documents in order with the number of ids before each."""
    names = f"part long, start long, id {kind}, n long, root binary, chunks binary, sizes binary"
    if not _exists(spark, f"{folder}/recipes/kind=0"):
        return spark.createDataFrame([], names)
    rows = spark.read.schema(names).parquet(f"{folder}/recipes/kind=0")
    #: One row for each recipe partition.
    parts = manifest(spark, folder).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, n (ids), root of each recipe partition; there are as many as tasks wrote recipes."""
    schema = "part long, start long, n long, root binary"
    where = f"{folder}/recipes/kind=1"
    return (spark.read.schema(schema).parquet(where) if _exists(spark, where) else spark.createDataFrame([], schema)).select("part", "n", "root")


def _above(parts: list) -> str:
    """The root over those of all recipe partitions, in their order."""
    return merkle([bytes(r["root"]) for r in parts]).hex()


def dataset_root(spark: SparkSession, folder: str) -> str:
    return bytes(spark.read.schema("root binary, parts long, n long").parquet(f"{folder}/dataset").first()["root"]).hex()


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Work out the roots of all recipe partitions and of the dataset again, and raise unless they are those that
    were written. A row for each recipe partition comes to the driver."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, n = None, [], 0
        done = lambda: pa.RecordBatch.from_pydict({"part": [part], "n": [n], "root": pa.array([merkle(leaves)], pa.binary())})
        for batch in batches:
            for p, size, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "root"))):
                if p != part and leaves:
                    yield done()
                    leaves, n = [], 0
                part, n = p, n + size
                leaves.append(hashlib.sha256(root).digest())
        if leaves:
            yield done()

    kept = sorted(tuple(r) for r in manifest(spark, folder).collect())
    found = []
    if _exists(spark, f"{folder}/recipes/kind=0"):
        rows = spark.read.schema("part long, start long, n long, root binary").parquet(f"{folder}/recipes/kind=0")
        found = sorted(tuple(r) for r in rows.repartition("part").sortWithinPartitions("part", "start").select("part", "n", "root").mapInArrow(rooted, "part long, n long, root binary").collect())
    if kept != found or merkle([bytes(root) for _, _, root in found]).hex() != dataset_root(spark, folder):
        raise ValueError(f"the recipes below {folder} do not match their manifest")


def _pieces(recipes: DataFrame) -> DataFrame:
    """root, place, key, size, behind (ids after it) of each chunk of distinct recipes, which are held against
    their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, keys, sizes, count = batch.column("root").to_pylist(), [], [], []
            for root, chunks, size in zip(roots, batch.column("chunks").to_pylist(), batch.column("sizes").to_pylist()):
                own = _split(chunks)
                if 4 * len(own) != len(size) or merkle(_leaves(own, size)) != root:
                    raise ValueError(f"a recipe does not match its root {root.hex()}")
                keys += own
                sizes.append(size)
                count.append(len(own))
            size = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
            total, last = np.cumsum(size), np.cumsum(count, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("root").take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array(np.arange(len(keys)) - np.repeat(last - count, count)), pa.array(keys, pa.binary()), pa.array(size), pa.array(np.repeat(total[last - 1], count) - total)],
                ["root", "place", "key", "size", "behind"],
            )

    distinct = recipes.groupBy("root").agg(F.first("chunks").alias("chunks"), F.first("sizes").alias("sizes"))
    return distinct.mapInArrow(run, "root binary, place long, key binary, size long, behind long")


def _whole(pieces: DataFrame, chunk: DataFrame, value: str) -> DataFrame:
    """The pieces with their chunk's value; a chunk that is missing, or not as long as its recipe says, is an error."""
    bad = F.col(value).isNull() | (F.col("size") != F.col("found"))
    said = F.raise_error(F.concat(F.lit("a missing or altered chunk: "), F.hex("key")))
    return pieces.join(chunk, "key", "left").withColumn(value, F.when(bad, said).otherwise(F.col(value)))


def verify(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of each document, read from the files.

    Every chunk is read once, held against its address and reduced to its CRC-32; the CRC-32 of a document
    follows from those of its recipe's chunks and what lies behind each, so that ids are not shuffled and a long
    document is no group. Recipes, recipe partitions and the dataset are held against their roots. Documents with
    the same root are worked out once. Anything missing or altered is an error."""
    check_manifest(spark, folder)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_unpacked(a, d) for a, d in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64()), pa.array(map(len, got), pa.int64())], ["key", "crc", "found"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, behind = batch.column("crc").to_numpy(), 4 * batch.column("behind").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(crc_before(crc, behind).astype(np.int64))], ["root", "crc"])

    recipes = _recipes(spark, folder, kind)
    chunk = _chunks(spark, folder).select("key", "data").mapInArrow(check, "key binary, crc long, found long")
    added = _whole(_pieces(recipes), chunk, "crc").select("root", "crc", "behind").mapInArrow(combine, "root binary, crc long")
    whole = materialised(added.groupBy("root").agg(F.bit_xor("crc").alias("ids_crc32")), "token-roots")
    rows = recipes.select("id", "start", F.col("n").alias("n_tokens"), "root")
    #: Roots that more than a thousandth of all documents share are under a thousand: they need no shuffle.
    shared = rows.groupBy("root").count().where(F.col("count") > rows.count() / 1000).select("root")
    hot = materialised(whole.join(shared, "root"), "token-hot-roots")
    often = rows.join(F.broadcast(hot), "root")
    rest = rows.join(F.broadcast(hot.select("root")), "root", "left_anti").join(whole, "root")
    return often.unionByName(rest).select("id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """id, start, ids (array) of each document, put together from its chunks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_unpacked(a, d).astype(np.int64) for a, d in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(got, pa.list_(pa.int64())), pa.array(map(len, got), pa.int64())], ["key", "ids", "found"])

    check_manifest(spark, folder)
    recipes = _recipes(spark, folder, kind)
    chunk = _chunks(spark, folder).select("key", "data").mapInArrow(unpack, "key binary, ids array<long>, found long")
    used = _whole(_pieces(recipes), chunk, "ids")
    whole = used.groupBy("root").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    return recipes.select("id", "start", "root").join(whole, "root").select("id", "start", "ids")


def store_and_verify(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the store to the shared folder and read it back; no rows give none."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    write_store(docs, folder, tokenizer, end_id, id_column, text_column)
    return verify(spark, folder, docs.schema[id_column].dataType.simpleString()).withColumnRenamed("id", id_column)
