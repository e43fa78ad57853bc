"""Operator 7: WARC archives with revisit resolution.

Headers (digest and id, no payload) are shuffled by payload digest to find the original of each payload; the resolved
headers then meet their payloads by page, and records are written: responses with payload, revisits with a reference to
the original. Every record is compressed alone, so that it can be read from its place in an archive, and an archive ends
at ``FILE_BYTES``. Reading parses the archives by Content-Length, so a payload may hold anything, a record head included;
revisits are then joined to the original responses for what only those carry.

Spark's text writer puts a separator behind each value. The last byte of a gzip member is the highest byte of its length,
zero below 16 MiB, and that zero byte is the separator: an archive is nothing but its members one after another. A larger
record is written in several members.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import shared_folder, table

#: Payloads of fewer bytes are never revisited.
MIN_BYTES = 0
#: Compressed bytes after which a task begins the next archive file.
FILE_BYTES = 64 << 20
#: Bytes of a gzip member before compression; below 2^24, see above.
MEMBER_BYTES = (1 << 24) - 1
_EOL = "\r\n"
_NUMBER = re.compile(r"<urn:page:(-?\d+):")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("digest_ok", T.BooleanType()),
    ]
)
_ARROW_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
_ARROW = pa.schema([(f.name, kind) for f, kind in zip(RECORD.fields, _ARROW_TYPES)])


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def digest_of(payload: Column) -> Column:
    """SHA-1 in base 32: 40 hexadecimal digits as four numbers of eight digits to the base 32."""
    digits = F.sha1(payload)
    eighths = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eighths), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the headers that become revisits.

    Of records with one digest those with the smallest page_id are responses; a null page_id is larger than all others.
    The smallest id of a digest combines map-side; a digest that very many pages share meets one row in the join.
    """
    able = headers.filter(F.col("payload_bytes") >= min_bytes)
    original = able.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    later = able.join(original, "payload_digest").filter(
        F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    )
    return later.select("page_id", "payload_digest", "refers_to").distinct()


def _record_id(page: Column) -> Column:
    """Of the page and its payload: pages that share an id have records of their own unless the payload is the same too."""
    number = F.coalesce(page.cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:page:"), number, F.lit(":"), F.col("payload_digest"), F.lit(">"))


def _head(record_type: Column, length: Column) -> Column:
    """A fresh header; a line whose value is null is left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_EOL))
    parts = [
        F.lit("WARC/1.1" + _EOL),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), _record_id(F.col("refers_to")))),
        line("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit(_PROFILE))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", length),
        F.lit(_EOL),
    ]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _members(record: memoryview) -> bytes:
    """The record as gzip members; the zero byte that ends the last one is left to the writer."""
    parts = [record[i : i + MEMBER_BYTES] for i in range(0, len(record), MEMBER_BYTES)]
    return b"".join(gzip.compress(p, 6, mtime=0) for p in parts)[:-1]


def _compressed(file_bytes: int):
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = 0
        for batch in batches:
            rows, held = [], 0
            for record in batch.column(0):
                if size >= file_bytes:
                    file, size = file + 1, 0
                rows.append((file, _members(memoryview(record.as_buffer()))))
                size += len(rows[-1][1])
                held += len(rows[-1][1])
                if held > 4 << 20:
                    yield _files(rows)
                    rows, held = [], 0
            yield _files(rows)

    return compress


def _files(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    file, value = ([r[i] for r in rows] for i in (0, 1))
    return pa.record_batch([pa.array(file, pa.int32()), pa.array(value, pa.binary())], names=["file", "value"])


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) as archives below ``folder``, a gzip member per record.

    A null html has an empty payload, a null url no such header line, a null page_id no number in its record id. Rows that
    repeat both page_id and payload are alike: all are responses or all are revisits, under one record id. Other columns
    are not read. An archive ends with the record that brings it to ``file_bytes`` compressed bytes.
    """
    payload = payload_of(F.col("html"))
    page = pages.select("page_id", "url", payload.alias("payload"), digest_of(payload).alias("payload_digest"))
    headers = page.select("page_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    later = resolve(headers, min_bytes)
    later = later.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
    same = page["page_id"].eqNullSafe(later["_id"]) & (page["payload_digest"] == later["_digest"])
    page = page.join(later, same, "left")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    record = F.concat(_head(kind, F.octet_length(body)), body, F.lit(_EOL * 2)).cast("binary")
    members = page.select(record.alias("record")).mapInArrow(_compressed(file_bytes), "file int, value binary")
    members = members.select("file", F.col("value").cast("string").alias("value"))
    members.write.partitionBy("file").option("lineSep", "\0").text(folder)


def _records(data: io.BufferedIOBase) -> Iterator[dict]:
    while True:
        first = data.readline()
        if not first:
            return
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"no record head but {first[:40]!r}")
        head = {}
        while (line := data.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            head[name.decode()] = value.decode()
        payload = data.read(int(head["Content-Length"]))
        if data.read(4) != b"\r\n\r\n":
            raise ValueError("record of another length than its head says")
        number = lambda name: int(found[1]) if (found := _NUMBER.match(head.get(name, ""))) else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = head["WARC-Type"] == "response"
        yield {
            "page_id": number("WARC-Record-ID"),
            "url": head.get("WARC-Target-URI"),
            "record_type": head["WARC-Type"],
            "payload_digest": digest,
            "refers_to": number("WARC-Refers-To"),
            "payload": payload if whole else None,
            "digest_ok": base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if whole else None,
        }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            with gzip.open(io.BytesIO(content.as_py())) as data:
                for row in _records(data):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives below ``folder``, payloads of responses included. A file, which ``write`` bounds by its
    bytes, is read by one task and unpacked as a stream. A damaged record is an error. No archives: no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("content").mapInArrow(_parse, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits get what the original response has."""
    seen = records.select(
        "page_id", F.octet_length("payload").cast("long").alias("bytes"), "payload_digest", "record_type", "refers_to"
    )
    original = seen.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("bytes").alias("of_original"))
    out = seen.join(original, "payload_digest", "left")
    return out.select(
        "page_id", F.coalesce("bytes", "of_original").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_folder(spark, "warc")
    write(pages, folder)
    return resolved(read(spark, folder))


_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h FROM p
), o AS (
  SELECT h, min(page_id) AS first_id FROM d GROUP BY h
), b AS (
  SELECT DISTINCT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')
    AS payload_digest FROM o
)
SELECT d.page_id, d.payload_bytes, b.payload_digest,
  CASE WHEN d.page_id = o.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = o.first_id THEN NULL ELSE o.first_id END AS refers_to
FROM d JOIN o USING (h) JOIN b USING (h)
"""

QUERIES = {"op7_warc_revisits": query}
ORACLE = {"op7_warc_revisits": _SQL}
