import base64
import gzip
import hashlib
import pathlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convspark.llm import warc as A
from tests.llm.fixtures import frame

SCHEMA = "page_id long, url string, html string"
BODIES = ["<p>a</p>", "<p>a</p>", "", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é\r\n\r\n日本", "x" * 300_000, "<p>a</p>", "\n", "\r\n\r\n"]


def pages():
    rows = [(i, f"http://h/{i}", b) for i, b in enumerate(BODIES)]
    return [*rows, rows[6], (None, None, "lone"), (None, "u\r\nx", "<p>a</p>"), (20, "http://h", "lone"), (20, "http://h", "lone")]


def digest(body):
    return base64.b32encode(hashlib.sha1((body or "").encode()).digest()).decode()


def plain(rows, least=0):
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    out = []
    for i, _, b in rows:
        size = len((b or "").encode())
        origin = first.get(b or "")
        again = size >= least and origin is not None and i != origin
        out.append((i, size, digest(b), "revisit" if again else "response", origin if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    A.write(frame(spark, pages(), SCHEMA).withColumn("value", F.lit(1)).repartition(3), f"{tmp_path}/w", least)
    records = A.read(spark, f"{tmp_path}/w")
    got = Counter(map(tuple, A.resolved(records).collect()))
    assert got == plain(pages(), least)
    for r in records.collect():
        assert r.digest_ok is (True if r.record_type == "response" else None)
        assert (r.payload is None) == (r.record_type == "revisit")
    assert {r.page_id: bytes(r.payload).decode() for r in records.collect() if r.payload is not None}[5] == BODIES[5]


def archives(folder):
    return [p for p in pathlib.Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]


def members(data):
    """Of each gzip member its place and content."""
    at = 0
    while at < len(data):
        unpack = zlib.decompressobj(31)
        content = unpack.decompress(data[at:])
        assert unpack.eof
        yield at, content
        at = len(data) - len(unpack.unused_data)


def test_records_are_members_of_bounded_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 40, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=20_000))) for i in range(60)]
    A.write(frame(spark, rows, SCHEMA).coalesce(1), f"{tmp_path}/w", file_bytes=100_000)
    found = [list(members(p.read_bytes())) for p in archives(f"{tmp_path}/w")]
    assert len(found) > 3 and sum(map(len, found)) == 60
    assert all(p.stat().st_size < 100_000 + 20_000 for p in archives(f"{tmp_path}/w"))
    records = [content for file in found for _, content in file]
    assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    ids = [next(x for x in r.split(b"\r\n") if x.startswith(b"WARC-Record-ID")) for r in records]
    assert len(set(ids)) == 60  # twenty page ids occur twice, with another payload


def test_a_record_refers_to_the_id_of_its_original(spark, tmp_path):
    A.write(frame(spark, [(3, "u", "a"), (1, "u", "a"), (1, "u", "b"), (5, "u", "b")], SCHEMA), f"{tmp_path}/w")
    records = [c.decode() for p in archives(f"{tmp_path}/w") for _, c in members(p.read_bytes())]
    head = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n")[1:]) for r in records]
    responses = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in head if h["WARC-Type"] == "response"}
    revisits = [h for h in head if h["WARC-Type"] == "revisit"]
    assert len(responses) == len(revisits) == 2
    assert all(responses[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in revisits)


def test_a_record_of_many_members():
    record = bytes(range(256)) * 200_000  # 51 MB
    data = A._members(memoryview(record)) + b"\0"
    found = list(members(data))
    assert len(found) == 4 and b"".join(c for _, c in found) == record
    assert gzip.decompress(data) == record


def test_no_pages(spark, tmp_path):
    A.write(frame(spark, [], SCHEMA), f"{tmp_path}/w")
    assert A.resolved(A.read(spark, f"{tmp_path}/w")).count() == 0


def test_damaged_archive_is_an_error(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha1:X\r\n\r\nabcdef"))
    with pytest.raises(Exception, match="another length"):
        A.read(spark, f"{tmp_path}/w").collect()
