"""WARC archives with dictionary compression, written and read through Spark's own file layer.

An archive is a .warc.zst file: a skippable frame holds a Zstandard dictionary that was built from a
bounded sample of the records, and every record follows as a frame of its own. Records with equal
payloads are stored once: that with the smallest page_id is the response, the others revisit it.

Files are written by Spark's text sink, whose line separator is a skippable frame without content, so
archives can live wherever Spark can write. An archive holds about archive_bytes of payload.

Null html is an empty payload. Rows that share the smallest page_id of a payload are all responses. A
null page_id never is the smallest one while there is another; records without any id refer to nothing
and are responses. Only page_id, url and html of the input are used. Control characters in a url are
percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.llm.common import bounded_batches, durable, id_key, kept_path, spread_join

#: Fixed values of the format: a dictionary's skippable frame, and an empty one of another number as separator.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Bounds of what the dictionary is built from, and of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 65_536
ARCHIVE_BYTES, LEVEL, MIN_BYTES = 64 << 20, 3, 0
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest(), version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit without the payload if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, the samples' own bytes where they are too few to train on, or nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
        return raw if len(raw) >= 8 else b""


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive. Raises ValueError where the archive is damaged."""
    dictionary, at = b"", 0
    if archive[:4] == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(archive[4:8], "little")
        dictionary = archive[8:at]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    stream = io.BufferedReader(reader.stream_reader(io.BytesIO(memoryview(archive)[at:]), read_across_frames=True))
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(head["Content-Length"]):
            raise ValueError(f"record {head.get('WARC-Record-ID')} is cut off")
        yield head, block


def _sources(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))


def _seen(pages: DataFrame, min_bytes: int) -> DataFrame:
    """key, sha, page_id of the records that take part in deduplication, as a durable table: digests alone."""
    return durable(_sources(pages).filter(F.length("payload") >= min_bytes).select(id_key("page_id").alias("key"), "sha", "page_id"), "digests")


def revisits(seen: DataFrame) -> DataFrame:
    """key, sha, refers_to of the records whose payload another record holds. Only digests are grouped and joined; a payload that much of all rows have stays where it is."""
    first = seen.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")  # min ignores null ids
    return spread_join(seen, durable(first, "payloads"), ["sha"], seen.count()).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("key", "sha", "refers_to").distinct()


def sampled(pages: DataFrame, seen: DataFrame) -> list[bytes]:
    """Records to build the dictionary from: the heads of the SAMPLE_RECORDS different payloads with the least digests. Digests are sorted alone."""
    least = [r.sha for r in seen.select("sha").distinct().orderBy("sha").limit(SAMPLE_RECORDS).collect()]
    one = F.min(F.struct(id_key("page_id").alias("key"), "page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")))
    rows = _sources(pages).filter(F.col("sha").isin(least)).groupBy("sha").agg(one.alias("r")).orderBy("sha").select("r.*").collect() if least else []
    return [record(r.page_id, r.url, bytes(r.payload)) for r in rows]


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str = DATE) -> None:
    """Archives of pages (page_id, url, html) under path, which must not exist."""
    bounded_batches(pages.sparkSession)
    source = _sources(pages)
    seen = _seen(pages, min_bytes)
    dictionary = build_dictionary(sampled(pages, seen))
    opening = DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, first = _compressor(dictionary, level), True
        for batch in batches:
            out = [opening] if first and opening and batch.num_rows else []
            first = first and not batch.num_rows
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                out.append(compressor.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    total = source.agg(F.sum(F.length("payload") + 512)).first()[0] or 0
    n = max(1, -(-total // archive_bytes))
    refers = durable(revisits(seen), "revisits").repartition(n, "key", "sha")  # of known size: the join is not planned anew, which would shuffle payloads again
    rows = source.withColumn("key", id_key("page_id")).repartition(n, "key", "sha").join(refers, ["key", "sha"], "left")
    rows.select("page_id", "url", "payload", "refers_to").mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null in revisits); digests are verified."""
    bounded_batches(spark)
    names = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        number = lambda name: int(head[name]) if name in head else None
        return number("Page-Id"), head.get("WARC-Target-URI"), kind, number("Refers-To-Page-Id"), digest, size, payload if kind == "response" else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for head, block in parse(content.as_py()):
                    held.append(row(head, block))
                    size += len(block)
                    if size > 4 << 20 or len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=list(names))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=list(names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(rows, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def restore(records: DataFrame) -> DataFrame:
    """page_id, url, html: the archived pages, revisits with the payload of the response they refer to."""
    held = records.filter("record_type = 'response'").select(F.col("payload_digest"), F.col("payload").alias("__p")).dropDuplicates(["payload_digest"])
    again = records.filter("record_type = 'revisit'").drop("payload").join(held, "payload_digest").withColumnRenamed("__p", "payload")
    return records.filter("record_type = 'response'").unionByName(again).select("page_id", "url", F.col("payload").cast("string").alias("html"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """The records of pages as archives in the shared folder give them back."""
    path = kept_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
