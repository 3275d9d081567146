import base64
import gzip
import hashlib
import os
import uuid

import pytest

from compare import connect, difference
from labelgauge.llm import warc
from labelgauge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

V1 = b"1 0 crawl\nURL IP-address Archive-date Content-type Archive-length\n\n"
V2 = b"2 0 crawl\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"


def arc(version, records):
    body = V1 if version == 1 else V2
    out = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain %d\n%s" % (len(body), body)
    for url, date, data in records:
        more = b"" if version == 1 else b"200 - - 17 x.arc "
        out += b"%s 10.0.0.1 %s text/html %s%d\n%s\n" % (url, date, more, len(data), data)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_equals_the_sql(spark):
    wrong, rows = difference(QUERIES["op8_arc_to_warc"](spark, SF), connect(SF), ORACLES["op8_arc_to_warc"])
    assert wrong is None and rows == 50


def test_both_versions_round_trip(spark, tmp_path):
    odd = bytes(range(256)) + b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    one = [(b"http://a/x y", b"19970102030405", HTTP + b"page"), (b"dns:a", b"199701", odd), (b"http://b/", b"19970102030406", HTTP)]
    two = [(b"http://c/", b"19990101000000", HTTP + b"page"), (b"http://d/", b"19990101000000", b"")]
    files = [(3, arc(1, one)), (1, gzip.compress(arc(2, two))), (2, None)]
    df = spark.createDataFrame(files, "key long, arc binary")
    records = warc.with_revisits(warc.converted(df))
    path = warc.write_warc(records, str(tmp_path / "w"), per_file=2)
    got = {(r.target_uri): r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == 5 and all(r.intact for r in got.values())
    assert got["http://a/x y"].record_type == "revisit" and got["http://a/x y"].refers_to == 1
    assert got["http://c/"].record_type == "response" and got["http://c/"].refers_to is None
    assert got["dns:a"].record_type == "resource" and got["dns:a"].payload_bytes == len(odd)
    assert got["dns:a"].payload_digest == warc.digest(odd)
    # equal empty payloads: those of the HTTP record without a body and of the record without bytes
    assert got["http://b/"].record_type == "revisit" and got["http://d/"].record_type == "resource"
    assert {r.record_id for r in got.values()} == {str(uuid.UUID(r.record_id)) for r in got.values()}
    dates = {r.url: r.date for r in records.collect()}
    assert dates["http://a/x y"] == "1997-01-02T03:04:05Z" and dates["dns:a"] == "1997-01-01T00:00:00Z"
    again = {r.url: r.record_id for r in warc.converted(df).collect()}
    assert again == {u: r.record_id for u, r in got.items()}


def test_broken_archives_raise():
    good = arc(1, [(b"http://a/", b"19970101000000", b"abc")])
    assert [f["url"] for f, _ in warc.arc_records(good)] == ["http://a/"]
    for bad in (good[:-3], b"no archive\n", good.replace(b"1 0 crawl", b"7 0 crawl"), good.replace(b"text/html 3", b"text/html x")):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))
    assert list(warc.arc_records(b"")) == []


def test_odd_pages(spark, tmp_path):
    rows = [(1, None, None, "k"), (2, "http://x/ a", "", "k"), (None, "u", "é" * 100_000, "k"), (3, "u", "é" * 100_000, "k"), (3, "u", "é" * 100_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    records = warc.with_revisits(warc.converted(warc.as_arc(pages)))
    got = warc.read_warc(spark, warc.write_warc(records, str(tmp_path / "w"))).collect()
    seen = sorted((r.key or 0, r.record_type, r.payload_bytes, r.refers_to or 0) for r in got)
    assert seen == [(0, "revisit", 200_000, 3), (1, "response", 0, 0), (2, "revisit", 0, 1), (3, "response", 200_000, 0), (3, "response", 200_000, 0)]
    assert {r.payload_digest for r in got if r.payload_bytes} == {warc.digest(("é" * 100_000).encode())}
    empty = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert {r.payload_digest for r in got if not r.payload_bytes} == {empty}
    limited = warc.with_revisits(warc.converted(warc.as_arc(pages)), least_bytes=1)
    assert {r.key for r in limited.where("first IS NOT NULL").collect()} == {None}
    none = warc.with_revisits(warc.converted(warc.as_arc(pages.limit(0))))
    assert warc.read_warc(spark, warc.write_warc(none, str(tmp_path / "n"))).count() == 0
