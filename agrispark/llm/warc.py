"""Content-addressed WARC archive.

Two tables in a folder: ``payloads`` holds every distinct payload once under
its SHA-256, ``records`` holds the exact header block of every record with its
payload's digest. Original records come back by a join. ``export_warc`` writes them as
plain WARC files and ``read_warc`` reads such files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, materialize, prepare

#: Fixed values of the WARC 1.1 format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, 20 bits (five hex digits, four letters) at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32_LETTERS)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0,
                  id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row to the archive at ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest id is a response, the others revisit it. A null payload counts
    as empty, a null uri as an empty one, a null id as the lowest (its record id says
    ``null``). Of repeated rows with the largest id one is the response; the
    rest revisit that id. Only the three named columns are read. Digests of
    equal payloads are verified: one SHA-256 with two lengths or SHA-1 digests
    stops the write.
    """
    spark = prepare(pages.sparkSession)
    src = columns(pages, id_col, uri_col, payload_col).toDF("id", "uri", "payload")
    src = src.withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(src.select("id", F.coalesce(F.col("uri").cast("string"), F.lit("")).alias("uri"), F.sha2("payload", 256).alias("sha256"),
                                  base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n")), "warc-rows")
    groups = materialize(rows.groupBy("sha256").agg(
        F.max("id").alias("first_id"), F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "uri")).alias("top"),
        F.count(F.lit(1)).alias("copies"), F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("sha1").alias("sha1_least"), F.max("sha1").alias("sha1_most")), "warc-groups")
    if groups.where("n_least <> n_most or sha1_least <> sha1_most").limit(1).count():
        raise ValueError("payloads with one SHA-256 differ in length or SHA-1")
    # any of a digest's payloads: they are equal; copies meet before the shuffle
    src.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")

    name = lambda x: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(x).cast("string"), F.lit("null")), F.lit(">"))
    # of repeated rows with the largest id exactly one is the response
    tied = materialize(rows.join(groups.select("sha256", F.col("first_id"), F.col("top.uri").alias("first_uri")), "sha256"), "warc-tied")
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("id", "sha256").orderBy(F.desc("uri")))
    rec = tied.withColumn("revisit", (F.col("n") >= min_bytes) & ~(F.col("id").eqNullSafe(F.col("first_id")) & (nth == 1)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    header = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", name("id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean(F.col("uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", name("first_id")), line("WARC-Refers-To-Target-URI", clean(F.col("first_uri"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + body).cast("string")), F.lit(CRLF))
    rec.select("id", F.col("sha256"), header.alias("warc_header"), http.alias("http_header")).write.parquet(f"{path}/records")


def _restored(spark: SparkSession, path: str) -> DataFrame:
    """(id, sha256, record): the exact bytes of every record, headers and body, from the two tables.

    A response's body comes from the payloads by a join on its address; a
    revisit has no body, so its row, of which a payload may have very many, needs
    no join. A response whose payload isn't stored has a null record.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    revisit = F.col("warc_header").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    bodies = records.where(~revisit).join(payloads, "sha256", "left")
    bare = records.where(revisit).withColumn("payload", F.lit("").cast("binary"))
    head = F.concat(F.col("warc_header"), F.col("http_header")).cast("binary")
    return bodies.unionByName(bare).select("id", "sha256", F.concat(head, F.col("payload")).alias("record"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Read the archive back: one row per record, parsed from its restored bytes.

    (id, sha256, payload_bytes, payload_digest, record_type, refers_to,
    warc_header, http_header). Every record is put together again from its exact headers and
    its stored payload (``reconstruct`` has the bytes) and cut by its own lengths;
    length and digests are taken from the payload found in it. A revisit has
    those of the response it refers to, looked up by address and record id. A payload that
    doesn't match its address, a length or digest other than the headers tell, or a
    revisit whose response isn't there, stops the read. refers_to is the id as text.
    """
    blank, mismatch = CRLF + CRLF, F.raise_error(F.lit("payload and digest differ"))
    text = lambda c: F.col(c).cast("string")
    upto = lambda c: F.concat(F.substring_index(text(c), blank, 1), F.lit(blank))
    after = lambda c, head: F.expr(f"substring({c}, octet_length({head}) + 1)")
    field = lambda c, key: F.regexp_extract(c, rf"(?m)^{re.escape(key)}: ([^\r\n]*)", 1)
    name = lambda key: F.regexp_extract(field("warc_header", key), r"^<urn:record:(.*)>$", 1)
    cut = _restored(spark, path).withColumn("warc_header", upto("record")).withColumn("block", after("record", "warc_header"))
    cut = cut.withColumn("http_header", upto("block")).withColumn("payload", after("block", "http_header"))
    told = F.regexp_extract(field("warc_header", "WARC-Payload-Digest"), r"^sha1:(.*)$", 1)
    n = F.octet_length("payload").cast("long")
    whole = field("warc_header", "Content-Length") == F.octet_length("block").cast("string")
    sound = whole & (field("http_header", "Content-Length") == n.cast("string")) & (F.sha2("payload", 256) == F.col("sha256")) & (base32_sha1(F.col("payload")) == told)
    parsed = cut.select("id", "sha256", "warc_header", "http_header", field("warc_header", "WARC-Type").alias("record_type"), name("WARC-Record-ID").alias("record_id"),
                        name("WARC-Refers-To").alias("refers"), told.alias("told"), field("http_header", "Content-Length").alias("told_bytes"), n.alias("n"), base32_sha1(F.col("payload")).alias("sha1"),
                        F.coalesce(F.when(field("warc_header", "WARC-Type") == "revisit", whole).otherwise(sound), F.lit(False)).alias("sound"))
    parsed = materialize(parsed, "warc-parsed")
    out = ("id", "sha256", "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers") != "", F.col("refers")).alias("refers_to"), "warc_header", "http_header")
    full = parsed.where("record_type <> 'revisit'").withColumn("payload_bytes", F.col("n")).withColumn("payload_digest", F.when(F.col("sound"), F.col("sha1")).otherwise(mismatch))
    held = full.groupBy("sha256", F.col("record_id").alias("refers")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("held"))
    again = parsed.where("record_type = 'revisit'").join(held, ["sha256", "refers"], "left")
    same = F.col("sound") & (F.col("held") == F.col("told")) & (F.col("payload_bytes").cast("string") == F.col("told_bytes"))
    again = again.withColumn("payload_digest", F.when(F.coalesce(same, F.lit(False)), F.col("held")).otherwise(mismatch))
    return full.select(*out).unionByName(again.select(*out))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(id, record): the exact bytes of every record, headers and body, without the closing blank lines. A revisit has no body."""
    whole = F.coalesce(F.col("record"), F.raise_error(F.lit("a response's payload isn't stored")).cast("binary"))
    return _restored(spark, path).select("id", whole.alias("record"))


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """Write the archive as WARC files: Spark's text writer, with the blank lines between records as the line end."""
    reconstruct(spark, path).select(F.col("record").cast("string")).write.option("lineSep", CRLF + CRLF).text(target)


def parse_records(raw: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(header block, record id, body) of each record of a WARC file, by Content-Length."""
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at) + 4
        header = raw[at:head].decode()
        fields = dict(x.split(": ", 1) for x in header.split(CRLF)[1:] if ": " in x)
        end = head + int(fields["Content-Length"])
        yield header, fields["WARC-Record-ID"], raw[head:end]
        at = end + 4


def read_warc(spark: SparkSession, source: str) -> DataFrame:
    """(warc_header, record_id, body) of the records in WARC files, in any store that Spark reads. A file is parsed in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                for header, record_id, body in parse_records(x.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([header]), pa.array([record_id]), pa.array([body], pa.binary())], ["warc_header", "record_id", "body"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(source)
    return files.select("content").mapInArrow(run, "warc_header string, record_id string, body binary")
