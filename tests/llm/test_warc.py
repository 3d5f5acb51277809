import base64
import hashlib
import pathlib
from collections import defaultdict

import pytest
import zstandard

from codicil.llm import warc
from tests.llm.conftest import SF


def plain(rows):
    same = defaultdict(list)
    for key, _, html in rows:
        same[html or ""].append(key)
    for key, _, html in rows:
        payload = (html or "").encode()
        ids = [k for k in same[html or ""] if k is not None]
        first = max(ids) if ids else None
        revisit = len(same[html or ""]) > 1 and first is not None and key != first
        yield key, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None


def order(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("case", ["pages", "odd"])
def test_round_trip(spark, tmp_path, case):
    if case == "pages":
        frame = spark.read.parquet(f"{SF}/pages.parquet")
    else:
        rows = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "http://ü", None), (4, "http://e", ""), (None, None, "same"), (5, "u", "é" * 300_000), (6, "u", "P*M\x18\0\0\0\0 \r\n\r\n WARC/1.1"), (None, "x", "alone"), (2, "again", "same")]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as digest", "3 as payload")
    rows = [(r["page_id"], r["url"], r["html"]) for r in frame.collect()]
    warc.write_archives(frame, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=order) == sorted(plain(rows), key=order)
    texts = {(k, h or "") for k, _, h in rows}
    assert all((r["page_id"], r["payload"]) in texts for r in got if r["record_type"] == "response")


def test_archive_starts_with_its_dictionary_and_each_record_is_a_frame(spark, tmp_path):
    warc.write_archives(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), str(tmp_path / "w"))
    for file in pathlib.Path(tmp_path / "w").glob("part-*"):
        content = file.read_bytes()
        assert content[:4] == bytes.fromhex("5d2a4d18")
        size = int.from_bytes(content[4:8], "little")
        assert size > 1000
        records = list(warc.read_archive(content))
        alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
        assert alone.decompressobj().decompress(content[8 + size + 8 :]) == records[0]  # behind the separator frame
        assert len(content) < 0.6 * sum(map(len, records))


def test_minimum_size_and_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long text"), (4, "d", "long text")], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "a"), min_bytes=5)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "a"), payloads=False).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    warc.write_archives(frame.where("false"), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_a_damaged_archive_is_refused():
    frames = list(warc.archive_rows(warc.record_bytes(i, "u", b"x" * 5000, None) for i in range(3)))
    whole = b"".join(f + warc.EMPTY_FRAME.encode() for f in frames)
    assert len(list(warc.read_archive(whole))) == 3
    with pytest.raises(ValueError):
        list(warc.read_archive(whole[:-20]))
