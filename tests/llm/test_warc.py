import hashlib
import random
import struct

import pyarrow.fs as fs
import pytest
import zstandard
from pyspark.sql import functions as F

from tideline.llm import warc
from tideline.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, payload string, row string, size string, key string"


def pages():
    rng = random.Random(2)
    body = lambda n: "<html>" + " ".join(rng.choice(["<p>", "é", "text", "漢", "\r\n\r\n"]) for _ in range(n)) + "</html>"
    long, short = body(900), "<p>tiny</p>"
    rows = [(k, f"http://a/{k}", body(rng.randint(1, 800))) for k in range(30)]
    rows += [(100, "http://b", long), (104, None, long), (102, "http://c\nd", long), (200, "", short), (201, "u", short), (300, "u", None), (301, "u", "")]
    rows += [(104, None, long), (None, "http://n", "x" * 2000), (None, "http://m", long), (-5, "neg", "y" * 200_000)]
    return [(*r, "a", "b", "c", "d") for r in rows]


def wanted(rows):
    out, last = [], {}
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            last[raw] = max(last.get(raw, i), i)
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        revisit = i is not None and raw in last and last[raw] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[raw] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = warc.round_trip(spark, given).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == wanted(rows)
    assert warc.round_trip(spark, given.limit(0)).collect() == []


def test_archives_roll_over_and_keep_payloads(spark):
    rows = [r for r in pages() if r[0] is not None]
    given = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    manifest = warc.archive_pages(given, shared_dir(spark, "warc"), archive_bytes=2_000, sample_bytes=3_000)
    assert manifest.count() > 1
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest, with_payload=True).collect() if r["record_type"] == "response"}
    assert all(got[i] == (html or "") for i, _, html, *_ in rows if i in got) and len(got) >= 30


def test_each_archive_has_a_reader(spark):
    given = spark.createDataFrame(pages(), SCHEMA).repartition(20)
    manifest = warc.archive_pages(given, shared_dir(spark, "warc"), archive_bytes=1_000, sample_bytes=1_000)
    n, read = manifest.count(), warc.read_archives(manifest)
    assert n > 20 and read.rdd.getNumPartitions() == n
    assert sum(r[0] > 0 for r in read.groupBy(F.spark_partition_id()).count().select("count").collect()) > n // 2
    assert read.count() == len(pages())


def test_format(spark):
    given = spark.createDataFrame(pages(), SCHEMA).coalesce(1)
    path = warc.archive_pages(given, shared_dir(spark, "warc")).first()["path"]
    system, at = fs.FileSystem.from_uri(path)
    raw = system.open_input_stream(at).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and magic & 0xFFFFFFF0 == 0x184D2A50
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    one = unpack.decompressobj()
    first = one.decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ") and first.endswith(b"\r\n\r\n") and one.eof


def test_damage_is_found():
    page = {"page_id": 1, "url": "u", "payload": b"abc", "digest": hashlib.sha1(b"abc").hexdigest(), "revisit": False, "refers_to": None, "row": 0}
    raw = warc.record(page, "2024-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))
