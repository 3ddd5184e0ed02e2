import base64
import hashlib

import pytest
from agrispark.llm import warc
from agrispark.llm.common import scratch_path

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/\r\n5", "ünï\r\n\r\nWARC/1.1\r\n"),
         (6, "http://a/6", "x" * 300_000), (8, "http://a/8", "tie"), (8, "http://b/8", "tie"), (None, "http://a/none", "no id"), (None, "http://a/none2", "tie")]


def pages(spark, rows):
    full = [(*r, "clash", "clash", 1, "c") for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, payload string, sha256 string, n int, revisit string").repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(pages(spark, PAGES), path)
    return path


def test_read_back(spark, archive):
    got = sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, archive).collect()), key=str)
    want, done = [], set()
    for i, _, html in PAGES:
        top = max((k for k, _, h in PAGES if (h or "") == (html or "") and k is not None), default=None)
        first = i == top and (i, html) not in done
        done |= {(i, html)} if first else set()
        want.append((i, len((html or "").encode()), digest(html), "response" if first else "revisit", None if first else str(top)))
    assert got == sorted(want, key=str)


def test_payloads_once_and_records_whole(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({h or "" for _, _, h in PAGES})
    records = [bytes(r["record"]) for r in warc.reconstruct(spark, archive).collect()]
    bodies = sorted(body.split(b"\r\n\r\n", 1)[1] for r in records for _, _, body in warc.parse_records(r + b"\r\n\r\n") if b"WARC-Type: response" in r)
    assert bodies == sorted({(h or "").encode() for _, _, h in PAGES})


def test_files_round_trip(spark, archive):
    target = scratch_path(spark, "warc-files")
    warc.export_warc(spark, archive, target)
    back = warc.read_warc(spark, target).collect()
    assert sorted(r["warc_header"].encode() + bytes(r["body"]) for r in back) == sorted(bytes(r["record"]) for r in warc.reconstruct(spark, archive).collect())


def test_min_bytes_and_empty_table(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(pages(spark, PAGES), path, min_bytes=5)
    kinds = {(r["id"], r["payload_bytes"]): r["record_type"] for r in warc.read_archive(spark, path).collect()}
    assert kinds[(3, 0)] == kinds[(4, 0)] == kinds[(8, 3)] == "response" and kinds[(1, 11)] == "revisit"
    path = scratch_path(spark, "archive")
    warc.write_archive(pages(spark, []), path)
    assert warc.read_archive(spark, path).collect() == []


def test_changed_payload_stops_the_read(spark, archive):
    path = scratch_path(spark, "broken")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{path}/records")
    spark.read.parquet(f"{archive}/payloads").selectExpr("sha256", "concat(payload, cast('!' as binary)) AS payload").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload and digest differ"):
        warc.read_archive(spark, path).collect()


def altered(spark, archive, tag, records=None, payloads=None):
    path = scratch_path(spark, tag)
    spark.read.parquet(f"{archive}/records").selectExpr("id", "sha256", f"{records or 'warc_header'} AS warc_header", "http_header").write.parquet(f"{path}/records")
    spark.read.parquet(f"{archive}/payloads").where(payloads or "true").write.parquet(f"{path}/payloads")
    return path


@pytest.mark.parametrize("tag,records,payloads", [
    ("length", r"regexp_replace(warc_header, 'Content-Length: ', 'Content-Length: 9')", None),
    ("refers", r"regexp_replace(warc_header, 'Refers-To: <urn:record:7>', 'Refers-To: <urn:record:99>')", None),
    ("lost", None, "octet_length(payload) > 0")])
def test_reading_restores_each_record(spark, archive, tag, records, payloads):
    # only a read that puts the records together again, and follows what a revisit refers to, sees these
    assert len(warc.read_archive(spark, altered(spark, archive, "sound")).collect()) == len(PAGES)
    with pytest.raises(Exception, match="payload and digest differ"):
        warc.read_archive(spark, altered(spark, archive, tag, records, payloads)).collect()


def test_headers_come_back_from_the_restored_bytes(spark, archive):
    want = {(r["id"], r["warc_header"], r["http_header"]) for r in spark.read.parquet(f"{archive}/records").collect()}
    assert {(r["id"], r["warc_header"], r["http_header"]) for r in warc.read_archive(spark, archive).collect()} == want
