"""WARC archives: writing captures, reading records, assembling transactions.

Writing: a record ends with CRLF CRLF, so archives are written by Spark's text
sink with that line separator, through its commit protocol and to any store.
Each page gives a response (or revisit), a request and a metadata record. Which
of equal payloads is stored is decided by payload digest: largest ids are
found by a partial aggregation, only digests that occur again are joined, and
Spark can split that join at a hot digest.

Reading: whole files come through Spark's binary source; a task inflates and
parses its file piece by piece by Content-Length. Files are bounded by the
writer's partitions and by a number of records, RECORDS_PER_FILE or as many as
hold FILE_BYTES of payloads on average.

Assembly: requests and metadata name a record of their transaction in
WARC-Concurrent-To, and a response may name its request; names are resolved by
joins to the capture's response, and a partial aggregation by capture emits one nested
row each, never a list of unbounded length (the first record of a kind, and counts).

Defined results: null html is an empty payload; rows equal in page_id, url and
payload share one record id and come back as often as they were written; null
page_ids never are the response others refer to, unless nothing else could be;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, table, work_folder

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 10_000
#: Bytes of payloads in an archive, about, before compression.
FILE_BYTES = 128 << 20
COPIES = 10_000
END = "\r\n"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string"


def _record(kind: str, record_id: Column, headers: dict[str, Column], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.0{END}WARC-Type: {kind}{END}WARC-Record-ID: "), record_id, F.lit(f"{END}WARC-Date: 2024-01-01T00:00:00Z{END}")]
    for name, value in headers.items():
        lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END * 2), block)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, uri, payload, digest, refers_page and refers_uri (null: stored in full) of every page."""
    payload = F.coalesce("html", F.lit(""))
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\s\x00-\x20]+", "%20")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), (F.octet_length(payload) >= MIN_REVISIT_BYTES).alias("large"))
    again = rows.where("large").groupBy("digest").agg(F.max(F.struct("page_id", "uri")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    joined = rows.join(again, "digest", "left")
    refers = ~F.col("last.page_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "uri", "payload", "digest", F.when(refers, F.col("last.page_id")).alias("refers_page"), F.when(refers, F.col("last.uri")).alias("refers_uri"))


def page_record(page_id: Column, digest: Column, kind: str = "capture") -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a transaction of records for every page as gzip-compressed archives."""
    rows = captures(pages)
    # Pages of any size share the archives, so as many as hold FILE_BYTES on average; three records a page.
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 500)).first()[0] or 1.0
    records = max(3, min(RECORDS_PER_FILE, int(3 * FILE_BYTES / mean)))
    tag_of = lambda uri: F.concat("digest", F.lit(":"), F.lower(F.hex(F.xxhash64(uri))))
    tag = tag_of("uri")
    own, request = page_record(F.col("page_id"), tag), page_record(F.col("page_id"), tag, "request")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END * 2))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = {"WARC-Target-URI": F.col("uri"), "WARC-Payload-Digest": digest}
    http = "application/http; msgtype="
    response = _record("response", own, {**common, "Content-Type": F.lit(f"{http}response")}, F.concat(head, "payload"))
    target = page_record(F.col("refers_page"), tag_of("refers_uri"))
    revisit = _record("revisit", own, {**common, "WARC-Profile": F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), "WARC-Refers-To": target, "Content-Type": F.lit(f"{http}response")}, head)
    ask = _record("request", request, {"WARC-Target-URI": F.col("uri"), "WARC-Concurrent-To": own, "Content-Type": F.lit(f"{http}request")}, F.lit(f"GET / HTTP/1.1{END}{END}"))
    notes = _record("metadata", page_record(F.col("page_id"), tag, "metadata"), {"WARC-Target-URI": F.col("uri"), "WARC-Concurrent-To": request, "Content-Type": F.lit("application/warc-fields")}, F.lit(f"fetchTimeMs: 0{END}"))
    lines = rows.select(F.explode(F.array(ask, F.when(F.col("refers_page").isNull(), response).otherwise(revisit), notes)).alias("value"))
    lines.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(data: bytes, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of an archive, plain or gzip of one or more members."""
    buffer, at = bytearray(), 0
    inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more() -> bool:
        nonlocal at, inflate
        if at >= len(data):
            return False
        part = data[at : at + piece]
        at += len(part)
        if inflate is None:
            buffer.extend(part)
            return True
        buffer.extend(inflate.decompress(part))
        while inflate.eof and (rest := inflate.unused_data):
            inflate = zlib.decompressobj(31)
            buffer.extend(inflate.decompress(rest))
        return True

    def skip_blank_lines() -> None:
        n = 0
        while n < len(buffer) and buffer[n] in b"\r\n":
            n += 1
        del buffer[:n]

    while True:
        skip_blank_lines()
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
            skip_blank_lines()
        lines = buffer[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", 0))
        while len(buffer) < end + 4 + size and more():
            pass
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of all archives of a folder; payload is the block after HTTP headers."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0

            def out() -> pa.RecordBatch:
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)  # noqa: B023

            for data in batch.column(0):
                for h, block in parse(data.as_py()):
                    kind = h.get("warc-type", "")
                    web = "application/http" in h.get("content-type", "")
                    head, _, body = block.partition(b"\r\n\r\n") if web else (b"", b"", block)
                    size, digest = len(body), hashlib.sha1(body).hexdigest()
                    if kind == "revisit":
                        found = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        size, digest = (int(found[1]) if found else None), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), size, digest, *[body] * with_payload))
                    held += len(body) * with_payload + 500
                    if held > 8 << 20:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, copies, response, request, metadata, n_request, n_metadata."""
    fields = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("type").isin("response", "revisit"))
    captured = main.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"), F.max("concurrent_to").alias("request_id"), F.first(F.struct(*fields)).alias("response"))
    rest = records.where(F.col("type").isin("request", "metadata")).dropDuplicates(["record_id", "type", "concurrent_to"])
    # A record may name the response, the response may name it, or it names a record that does either.
    direct = rest.select("record_id", F.col("concurrent_to").alias("capture"))
    named = captured.where(F.col("request_id").isNotNull()).select(F.col("request_id").alias("record_id"), F.col("record_id").alias("capture"))
    alias = direct.union(named).join(captured.select(F.col("record_id").alias("capture")), "capture", "left_semi").groupBy("record_id").agg(F.min("capture").alias("capture"))
    via = rest.join(alias.select(F.col("record_id").alias("concurrent_to"), F.col("capture").alias("through")), "concurrent_to", "left").join(alias, "record_id", "left")
    own = F.when(F.col("type") == "request", F.struct(*fields))
    notes = F.when(F.col("type") == "metadata", F.struct(*fields))
    grouped = via.withColumn("to", F.coalesce("capture", "through")).where(F.col("to").isNotNull()).groupBy(F.col("to").alias("record_id"))
    parts = grouped.agg(F.min_by(own, F.when(own.isNotNull(), F.col("record_id"))).alias("request"), F.min_by(notes, F.when(notes.isNotNull(), F.col("record_id"))).alias("metadata"), F.count(own).alias("n_request"), F.count(notes).alias("n_metadata"))
    return captured.drop("request_id").join(parts, "record_id", "left").fillna(0, ["n_request", "n_metadata"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    # Assembly reads the records several times; archives are parsed once.
    rows = assemble(materialised(read_archives(spark, path), "records"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:capture:([^:]*):', 1) AS BIGINT)")
    # Two steps, so that no array is as long as a row is often repeated.
    first = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = first.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("copies"), F.col("from") + COPIES) - 1)))
    return each.select(page("record_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), page("response.refers_to").alias("refers_to"), "n_request", "n_metadata")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p),
r AS (SELECT *, n >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m AS again FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to,
       1::BIGINT AS n_request, 1::BIGINT AS n_metadata
FROM r
"""
