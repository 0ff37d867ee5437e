import hashlib

import pytest
from pyspark.sql import functions as F

from gaugemill.llm import warc as w

PAGES = "page_id long, url string, html string"
BIG, OTHER = "<p>é\r\n\r\nWARC/1.1\r\n" * 80, "x" * 1000


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://b/\r\nX: y", OTHER), (4, None, OTHER), (5, "http://c", "small"), (6, "http://c", "small"), (7, "u", None), (8, "u", ""), (None, "n", BIG), (9, "q", OTHER), (9, "q", OTHER)]
    return spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "payload": F.lit(2), "keeper": F.lit(3)})


def rebuilt(spark, pages, tmp_path, **how):
    w.write_archive(pages, str(tmp_path / "a"), **how)
    return w.read_archive(spark, str(tmp_path / "a"))


@pytest.mark.parametrize("small", [0, 100])
def test_payloads_are_stored_once_and_records_come_back(spark, pages, tmp_path, small):
    records = rebuilt(spark, pages, tmp_path, small=small)
    got = sorted((str(r.page_id), bytes(r.payload).decode(), r.record_type) for r in records.collect())
    want = sorted((str(r.page_id), r.html or "") for r in pages.collect())
    assert [(i, p) for i, p, _ in got] == want
    assert {(i, t) for i, _, t in got if t == "revisit"} == {("1", "revisit"), ("None", "revisit"), ("3", "revisit"), ("4", "revisit")}
    stored = spark.read.parquet(str(tmp_path / "a/payloads")).collect()
    assert sorted(bytes(r.payload).decode() for r in stored) == sorted({BIG, OTHER, "small", ""})
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest for r in stored)


def test_warc_files_round_trip(spark, pages, tmp_path):
    records = rebuilt(spark, pages, tmp_path)
    w.export_warc(records, str(tmp_path / "warc"), records_per_file=3)
    back = w.import_warc(spark, str(tmp_path / "warc"))
    key = lambda r: (str(r.page_id), r.record_type, r.header, bytes(r.payload) if r.record_type == "response" else b"")
    assert sorted(map(key, back.collect())) == sorted(map(key, records.collect()))
    header = next(r.header for r in records.collect() if r.page_id == 3)
    assert "WARC-Target-URI: http://b/%0D%0AX: y\r\n" in header and "WARC-Refers-To: <urn:page:9>\r\n" in header


def test_a_damaged_payload_is_noticed(spark, pages, tmp_path):
    w.write_archive(pages, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not have its digest"):
        w.read_archive(spark, str(tmp_path / "b")).collect()


def test_framed_records_are_taken_apart_again(spark, pages, tmp_path):
    records = rebuilt(spark, pages, tmp_path)
    framed = w.record_bytes(records)
    got = w.parsed_records(framed).collect()
    assert len(got) == 11 and all(bytes(r.body) == (bytes(r.payload) if r.record_type == "response" else b"") for r in got)
    assert sorted(r.header for r in got) == sorted(r.header for r in records.collect())
    for wrong in (F.concat("record", F.lit(b"x")), F.substr("record", F.lit(1), F.octet_length("record") - 1)):
        with pytest.raises(Exception, match="Content-Length"):
            w.parsed_records(framed.withColumn("record", wrong)).collect()


def test_very_long_pages(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", ("\r\n\r\n" + "é" * 50) * 40_000) for i in (1, 2)], PAGES)
    framed = w.record_bytes(rebuilt(spark, pages, tmp_path))
    assert [(r.record_type, len(r.payload)) for r in w.parsed_records(framed).orderBy("page_id").collect()] == [("revisit", 4_160_000), ("response", 4_160_000)]


def test_a_truncated_file_is_noticed():
    with pytest.raises(ValueError):
        list(w.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\nabc"))


def test_no_pages(spark, tmp_path):
    assert rebuilt(spark, spark.createDataFrame([], PAGES), tmp_path).count() == 0
