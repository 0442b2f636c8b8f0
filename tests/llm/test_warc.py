from datetime import datetime

import duckdb
import pytest
from helpers import rows_of

from canopy.llm import warc
from canopy.llm.queries import op2_warc

PAGES = "page_id long, url string, html string, note string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], PAGES)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    when = datetime(2006, 5, 4, 3, 2, 1)
    content = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 9\r\n\r\na\nb\r\n\r\nc\xc3\xa9"
    data = warc.gzip_member(warc.arc_version_block(version, "x.arc.gz")) + warc.gzip_member(warc.arc_record(version, "x.arc.gz", 9, "http://a b/", "1.2.3.4", when, content)) + warc.END
    (r,) = warc.parse_arc(data)
    assert (r["URL"], r["IP-address"], r["Archive-date"], r["content"]) == ("http://a b/", "1.2.3.4", "20060504030201", content)
    (parsed,) = warc.parse_warc(warc.gzip_member(warc.convert(r)) + warc.END)
    fields, block = parsed
    assert block == content and fields["WARC-Date"] == "2006-05-04T03:02:01Z" and fields["WARC-Type"] == "response"
    assert fields["X-Page-Id"] == "7" and fields["WARC-Payload-Digest"] == "sha1:" + warc.sha1_base32(warc.split_http(content)[1])
    (parsed,) = warc.parse_warc(warc.gzip_member(warc.convert(r, 3)))
    fields, block = parsed
    assert fields["WARC-Refers-To"] == warc.record_id(3, warc.sha1_base32(warc.split_http(content)[1]))
    assert fields["WARC-Type"] == "revisit" and fields["X-Refers-To-Page-Id"] == "3" and block == warc.split_http(content)[0]


def test_uncompressed_members_in_one():
    a = warc.arc_version_block(1, "x") + warc.arc_record(1, "x", 0, "http://a/", "0.0.0.0", datetime(2005, 1, 1), b"one") + warc.arc_record(1, "x", 0, "http://b/", "0.0.0.0", datetime(2005, 1, 1), b"")
    assert [r["content"] for r in warc.parse_arc(warc.gzip_member(a))] == [b"one", b""]


def test_damage_is_an_error():
    bad = warc.arc_version_block(1, "x") + b"http://a/ 0.0.0.0 20050101000000 text/html 100\nshort"
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parse_arc(warc.gzip_member(bad)))
    with pytest.raises(ValueError, match="version"):
        list(warc.parse_arc(warc.gzip_member(warc.arc_version_block(1, "x").replace(b"\n1 0", b"\n9 0"))))


def test_revisits_name_records_of_the_archives(spark, tmp_path):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a", "same"), (most, "b", "same"), (2**60, "c", "same"), (2**61 + 5, "d", "other"), (-1, "e", "other"), (None, "f", "other"), (None, "g", "same")]
    found = warc.archive(pages(spark, rows).repartition(3), place=f"file://{tmp_path}")
    assert rows_of(found.select("page_id", "refers_to")) == sorted([(least, None), (most, least), (2**60, least), (2**61 + 5, -1), (-1, None), (None, None), (None, None)], key=repr)
    records = [f for r in spark.read.format("binaryFile").load(f"file://{tmp_path}/warc").collect() for f, _ in warc.parse_warc(r.content)]
    kinds = {f["WARC-Record-ID"]: f["WARC-Type"] for f in records}
    assert len(kinds) == len(records)
    named = [f["WARC-Refers-To"] for f in records if f["WARC-Type"] == "revisit"]
    assert len(named) == 3 and {kinds[x] for x in named} == {"response"}


def test_revisits(spark):
    long = "<p>" + "word " * 200_000
    rows = [(5, "http://e", "same"), (3, "http://c", "same"), (9, None, "same"), (4, "http://d", None), (2, "http://b", ""), (7, "http://x y\nz", "ä\r\n\r\nWARC/1.0"), (None, "http://n", "same"), (8, "http://l", long), (8, "http://l", long), (6, "u", "\x00�")]
    found = warc.archive(pages(spark, rows).repartition(4), archive_bytes=300_000)
    got = rows_of(found.select("page_id", "record_type", "payload_bytes", "refers_to"))
    size = lambda t: len((t or "").encode())
    wanted = [(5, "revisit", 4, 3), (3, "response", 4, None), (9, "revisit", 4, 3), (4, "revisit", 0, 2), (2, "response", 0, None), (7, "response", size(rows[5][2]), None), (None, "response", 4, None), (8, "response", size(long), None), (8, "response", size(long), None), (6, "response", 4, None)]
    assert got == sorted(wanted, key=repr)
    assert {r.payload_digest for r in found.where("page_id IN (2, 4)").collect()} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}


def test_smaller_payloads_stay(spark):
    found = warc.archive(pages(spark, [(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "longer"), (4, "d", "longer")]), least_bytes=5)
    assert rows_of(found.select("page_id", "record_type", "refers_to")) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_empty(spark):
    assert warc.archive(pages(spark, [])).count() == 0


def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    found = op2_warc(spark, sf)
    assert rows_of(found) == sorted(duckdb.sql(warc.ORACLE).project(", ".join(found.columns)).fetchall(), key=repr)
