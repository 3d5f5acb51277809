"""WARC archives of web pages, compressed record by record with a shared dictionary.

An archive starts with a skippable Zstandard frame that holds a dictionary trained on
its own records (a bounded sample of them, spread over the archive's first records);
then each record is a frame of its own.  Records whose payload occurs several times are
stored once, as the response of the largest page id; the others are ``revisit`` records
that refer to it.

Archives are written and read by Spark, so any file system Spark knows will do: the
text writer puts down the bytes of each row as they are, and its line separator is an
empty skippable frame, which every Zstandard reader passes over.  One archive holds one
partition; partitions are bounded by Spark's split and advisory sizes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 3 << 20  # of records that a dictionary is trained on
PIECE_BYTES = 16 << 10  # of one record in the sample
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_DICTIONARY_FRAME = 0x184D2A5D
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
_ZSTD = 0xFD2FB528


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP head of its response but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:x-page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields (lower-case names), the HTTP head's length field and the payload (None in a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {"fields": fields, "length": length, "payload": None if fields["warc-type"] == "revisit" else payload}


def _dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or none where the records are too few or too small to train one."""
    pieces = [r[i : i + 2048] for r in records for i in range(0, min(len(r), PIECE_BYTES), 2048)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 10)
    if len(pieces) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_rows(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, then one for each record."""
    held: list[bytes] = []
    size, compressor = 0, None
    for record in records:
        if compressor is None:
            held.append(record)
            size += min(len(record), PIECE_BYTES)
            if size < SAMPLE_BYTES:
                continue
            yield from (frames := _opened(held))[0]
            compressor, held = frames[1], []
        else:
            yield compressor.compress(record)
    if compressor is None and held:
        yield from _opened(held)[0]


def _opened(held: list[bytes]) -> tuple[list[bytes], zstandard.ZstdCompressor]:
    trained = _dictionary(held)
    lead = struct.pack("<II", _DICTIONARY_FRAME, len(trained)) + trained
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
    return [lead, *map(compressor.compress, held)], compressor


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of one archive, in order."""
    view, at, decompressor = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if magic in _SKIPPABLE:
            if magic == _DICTIONARY_FRAME and size:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        elif magic == _ZSTD:
            one = decompressor.decompressobj()
            out = one.decompress(view[at:])
            if not one.eof:
                raise ValueError("archive ends within a record")
            yield out
            at = len(view) - len(one.unused_data)
        else:
            raise ValueError(f"no frame at byte {at}")


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0) -> None:
    """Writes every row of ``pages`` as a record into archives under ``folder``.

    Equal payloads of ``min_bytes`` bytes or more become one response (largest id; any
    one of several rows with that id is not singled out: all are responses) and revisits.
    A null payload is an empty one; a row without an id is a response if no row of its
    payload has one.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    repeated = repeated.where("n > 1 and response is not null").select("digest", "response")
    marked = rows.join(repeated, "digest", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    key, url, payload, other = (batch.column(c)[i].as_py() for c in range(4))
                    yield record_bytes(key, url, payload.encode("utf-8"), other)

        held, size = [], 0
        for frame in archive_rows(records()):
            held.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    frames = marked.select("id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Per record ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``, and ``payload`` if wanted.

    The digest and the length of a stored payload are computed from it and must equal
    the record's own.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def number(field: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", field or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in read_archive(content.as_py()):
                    parsed = parse_record(record)
                    fields, payload = parsed["fields"], parsed["payload"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and (len(payload) != parsed["length"] or base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii") != digest):
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    text = payload.decode("utf-8") if payloads and payload is not None else None
                    rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], parsed["length"], digest, fields["warc-type"], number(fields.get("warc-refers-to")), text))
                    size += len(record)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(folder).select("content")
    found = files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
    return found if payloads else found.drop("payload")
