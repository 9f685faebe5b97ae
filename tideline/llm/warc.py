"""WARC archives with dictionary-compressed records.

Each archive starts with a skippable frame that holds a Zstandard dictionary built from its own records;
every record after it is a frame of its own, so that a reader can start at any record. Of records with equal
payloads one is written as a response and the others as revisits of it."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import materialised, shared_dir, text_of

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"


def record_id(page_id: int | None, row: int) -> str:
    """Ids come from the page's id; pages without one take their row's number, in a range of its own."""
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 64) if page_id is not None else (1 << 64) + row)}>"


def record(page: dict, date: str) -> bytes:
    """A response, or a revisit without payload, as bytes."""
    payload, revisit = page["payload"], page["revisit"]
    digest = base64.b32encode(bytes.fromhex(page["digest"])).decode()
    http = HTTP_HEAD % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page['page_id'], page['row'])}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(page['url'].split())}"] if page["url"] and page["url"].strip() else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(page['refers_to'], 0)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, one made of the samples' own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


class _Archive:
    """One file: records are held back until there are enough of them to build its dictionary."""

    def __init__(self, system, path: str, size: int, sample: int, level: int):
        self.system, self.path, self.size, self.sample, self.level = system, path, size, sample, level
        self.held: list[bytes] = []
        self.held_bytes = self.written = self.records = 0
        self.out = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.out is not None:
            self._put(raw)
            return
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= self.sample:
            self._open()

    def _open(self) -> None:
        raw = dictionary(self.held, self.size)
        self.out = self.system.open_output_stream(self.path)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=_as_dictionary(raw), write_checksum=True, write_content_size=True)
        for x in self.held:
            self._put(x)
        self.held = []

    def _put(self, raw: bytes) -> None:
        self.written += self.out.write(self.packer.compress(raw)) or 0
        self.written = self.out.tell()

    def close(self) -> None:
        if self.out is None:
            self._open()
        self.out.close()


def write_archives(pages: DataFrame, folder: str, dictionary_bytes: int = 65_536, sample_bytes: int = 8_000_000, archive_bytes: int = 256_000_000, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, payload, digest, revisit, refers_to, row) below folder, one archive or
    more for each partition: a new one begins beyond `archive_bytes`. Returns path, records; only archives
    that this names are part of the result, so that a repeated task leaves nothing behind that counts.

    The dictionary of an archive is built from its first `sample_bytes` of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, archive, done = TaskContext.get(), None, []
        for batch in batches:
            for page in batch.to_pylist():
                if archive is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"
                    archive = _Archive(system, f"{base}/{name}", dictionary_bytes, sample_bytes, level)
                    done.append((f"{folder}/{name}", archive))
                archive.add(record(page, date))
                if archive.written >= archive_bytes:
                    archive.close()
                    archive = None
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([a.records for _, a in done], pa.int64())], ["path", "records"])

    return materialised(pages.mapInArrow(run, "path string, records long"), "warc-manifest")


def records_of(stream) -> Iterator[bytes]:
    """The records of an open archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=_as_dictionary(stream.read(size)))
    left = b""
    while True:
        more = stream.read(1 << 20) if not left else b""
        data = left + more
        if not data:
            return
        frame, out = unpacker.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                left = frame.unused_data
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    own, refers = (uuid.UUID(fields[k][10:-1]).int if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
    signed = lambda x: None if x is None or x >> 64 else x - (1 << 64) if x >> 63 else x
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": signed(own), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": signed(refers), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of each record.
    Payloads of responses are checked against their digests."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                system, at = fs.FileSystem.from_uri(path)
                rows, n = [], 0
                with system.open_input_stream(at) as stream:
                    for raw in records_of(stream):
                        rows.append(parse(raw))
                        n += 1
                        if len(rows) == 500:
                            yield pack(rows)
                            rows = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records, not {expected}")
                yield pack(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    #: A task for each archive, however small the manifest's rows are.
    return manifest.repartitionByRange(max(1, manifest.count()), "path").mapInArrow(run, schema + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", revisit_from: int = 1000, **options) -> DataFrame:
    """Write a record for each page and return the manifest (path, records).

    Of pages with equal payloads of at least `revisit_from` bytes the one with the largest id is a response,
    the others revisit it; all else is a response. Equal means the same SHA-256. A null payload is empty, a
    null id gives a record that reads back as null and never is the one that others refer to, repeated ids
    with equal payloads leave one response. Extra columns are ignored."""
    html = text_of(pages[html_column])
    given = pages.select(
        pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("size"), F.when(F.octet_length(html) >= revisit_from, F.sha2(html, 256)).alias("key"),
    )
    #: Sums within a task come first, so that a payload that many pages share is no hot key.
    largest = (
        given.where((F.col("size") >= revisit_from) & F.col("page_id").isNotNull())
        .groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("key", "keeper")
    )
    marks = (
        given.where(F.col("size") >= revisit_from).select("page_id", "key").join(largest, "key")
        .where("page_id != keeper").select("page_id", F.col("keeper").alias("refers_to"), "key").distinct()
    )
    rows = given.join(marks, ["page_id", "key"], "left").select(
        "page_id", "url", F.encode("html", "UTF-8").alias("payload"), F.sha1(F.encode("html", "UTF-8")).alias("digest"),
        F.col("refers_to").isNotNull().alias("revisit"), "refers_to", F.monotonically_increasing_id().alias("row"),
    )
    return write_archives(rows, folder, **options)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Archive pages in the shared folder and read the archives back."""
    return read_archives(archive_pages(pages, shared_dir(spark, "warc"), **options))
