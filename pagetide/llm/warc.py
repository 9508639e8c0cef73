"""WARC archives: write captures as transactions of records, read the records back, and assemble them again.

A capture is a request, a response (or a revisit of an earlier one with the same payload) and a metadata record, tied
together by WARC-Concurrent-To. Archives are written by Spark's own writer, a record to a row, so a lost task is written
anew; each record's trailing blank lines are the writer's line separator.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import content, shared_dir, table, written

CRLF = "\r\n"
REVISIT_BYTES = 1000
#: Captures in an archive at most, and bytes of their payloads on average. A reader holds one zipped archive and one record at a time.
ARCHIVE_CAPTURES, ARCHIVE_BYTES = 2_000, 1 << 27
#: Bytes that are unzipped at a time, and bytes of records that are passed on together.
CHUNK, BATCH = 1 << 20, 1 << 24
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, key: Column) -> Column:
    """A name of the record that follows from what it is, so that a rewritten archive has the same."""
    h = F.md5(F.concat_ws(":", F.lit(kind), key))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, j in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if i > 1 else []) + [F.substring(h, i, j)]), F.lit(">"))


def record(kind: str, name: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its trailing blank lines. Fields that are null are left out."""
    head = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", name), ("WARC-Date", F.lit(DATE)), *fields, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in head]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """id, url, payload, digest (SHA-1), refers_to (the id of the capture it revisits, or null)."""
    url = F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20"), F.lit(""))  # a header's value is one line
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), content(html_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    key = ["digest", F.sha2("payload", 256).alias("strong"), F.octet_length("payload").alias("size")]  # SHA-1 alone can be made to collide
    first = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy(*key).agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("strong", "first")
    # What can't revisit has a key that nothing has, rather than a null that they would all share.
    named = rows.withColumn("own", F.concat(F.when(F.octet_length("payload") >= revisit_bytes, "").otherwise("-"), F.sha2("payload", 256)))
    joined = named.join(first, F.col("own") == F.col("strong"), "left")
    return joined.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, compression: str = "gzip") -> None:
    """Writes a request, a response or revisit, and a metadata record for each page to WARC files in the folder path.

    The payload is the html in UTF-8, null counts as empty. Of equal payloads of at least revisit_bytes, the largest id's is
    a response and others revisit it; rows that repeat it are responses under one name. Control characters and spaces of a url are written as %20; a null url is
    empty. A null id is named by its url and payload. Other columns aren't read.

    An archive's payloads have ARCHIVE_BYTES at most and one payload more, wherever large pages lie.
    """
    rows = captures(pages, id_col, url_col, html_col, revisit_bytes)
    key = F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.md5("url")), "digest")
    name = record_id("response", key)
    path_of = F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = ("WARC-Target-URI", F.nullif("url", F.lit("")))
    size = F.octet_length("payload").cast("string")
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    again = F.col("refers_to").isNotNull()
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    response = record("response", name, [target, digest, http], F.concat(answer, "payload"))
    revisit = record("revisit", name, [target, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id("response", F.concat_ws("-", F.col("refers_to").cast("string"), "digest"))), digest, http], answer)
    request = record("request", record_id("request", key), [target, ("WARC-Concurrent-To", name), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    about = record("metadata", record_id("metadata", key), [target, ("WARC-Concurrent-To", name), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-length: "), size, F.lit(CRLF)))
    n, total = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(content(html_col)))).first()
    captured = max(1, min(ARCHIVE_CAPTURES, ARCHIVE_BYTES * n // max(1, total or 0)))
    # The writer counts rows, so a row stands for so many bytes: a larger payload is followed by empty rows, which are blank lines.
    share = max(1, ARCHIVE_BYTES // (3 * captured))
    blank = F.array_repeat(F.lit(""), F.when(again, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / share) - 3)).cast("int"))
    lines = rows.select(F.explode(F.concat(F.array(request, F.when(again, revisit).otherwise(response), about), blank)).alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", compression).option("maxRecordsPerFile", 3 * captured).text(path)


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
BLANK = re.compile(rb"\r?\n\r?\n")


def parsed(chunks):
    """kind, fields (lower-case names), block of each record in the bytes that come in chunks. Records end where their Content-Length says, whatever their block holds."""
    chunks, data, at = iter(chunks), b"", 0

    def more() -> bool:
        nonlocal data, at
        if (new := next(chunks, None)) is None:
            return False
        data, at = data[at:] + new, 0
        return True

    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at == len(data):
            if more():
                continue
            return
        while not (end := BLANK.search(data, at)):
            if not more():
                raise ValueError("a record is cut off" if data[at : at + 5] == b"WARC/" else "no WARC record")
        if data[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record")
        lines = data[at : end.start()].split(b"\n")[1:]
        fields = {m[1].strip().lower().decode(): m[2].strip().decode("utf-8", "replace") for x in lines if (m := HEADER.match(x))}
        at = end.end()
        size, parts, have = int(fields["content-length"]), [], 0
        while True:
            part = data[at : at + size - have]
            parts.append(part)
            have, at = have + len(part), at + len(part)
            if have == size:
                break
            if not more():
                raise ValueError("a record is cut off")
        yield fields.get("warc-type", ""), fields, b"".join(parts)


def unzipped(data: bytes):
    """The data of gzip members, of which an archive may have one or one for each record, in chunks; or data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            feed = z.unconsumed_tail or view[at : at + CHUNK]
            if not z.unconsumed_tail:
                at += len(feed)
            if not (out := z.decompress(feed, CHUNK)) and not len(feed):
                raise ValueError("an archive is cut off")
            if out:
                yield out
        at -= len(z.unused_data)


RECORD = "record_id string, kind string, uri string, concurrent_to string, refers_to string, payload_digest string, content_type string, block_bytes long, payload_bytes long, payload_sha1 string, fields string, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in the folder path. payload: what follows the HTTP header, or a block that isn't HTTP; null unless with_payload.

    fields: the text of a warc-fields block. A damaged archive is an error.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.string() for x in RECORD.split(", ")]

    def of(batches):
        for b in batches:
            for data in b.column(0):
                out, held = [], 0
                for kind, f, block in parsed(unzipped(data.as_py())):
                    media = f.get("content-type", "")
                    payload = block.partition(b"\r\n\r\n")[2] if media.startswith("application/http") else block
                    fields = block.decode("utf-8", "replace") if media.startswith("application/warc-fields") else None
                    out.append((f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-payload-digest"), media, len(block), len(payload), hashlib.sha1(payload).hexdigest(), fields, payload if with_payload else None))
                    held += len(payload) if with_payload else len(fields or "")
                    if len(out) >= 500 or held >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(of, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """record_id, uri, response, request, metadata: a row for each response or revisit, with the request and metadata records that name it as concurrent.

    A capture without one of them has null there; of several, that with the smallest record_id counts. Requests and metadata
    that name no capture are left out. Records named twice, as by two archives of one crawl, count once for each.
    """
    columns = [c for c in records.columns if c not in ("record_id", "kind", "uri", "concurrent_to")]
    main = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "uri", F.struct("kind", *columns).alias("response"))
    side = records.where(F.col("kind").isin("request", "metadata")).where(F.col("concurrent_to").isNotNull()).select("concurrent_to", "kind", F.struct("record_id", "uri", "content_type", "block_bytes", "fields").alias("side"))
    sides = side.groupBy("concurrent_to").agg(*(F.min_by("side", F.when(F.col("kind") == k, F.col("side.record_id"))).alias(k) for k in ("request", "metadata")))
    sides = sides.withColumns({k: F.when(F.col(k).isNotNull(), F.col(k)) for k in ("request", "metadata")})
    return main.join(sides, F.col("record_id") == F.col("concurrent_to"), "left").drop("concurrent_to")


def transactions(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return assemble(read_records(spark, path, with_payload))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    records = written(read_records(spark, path, with_payload=False))  # so that an archive is read once
    whole = assemble(records)
    note = lambda name: F.nullif(F.regexp_extract("metadata.fields", rf"(?m)^{name}: *([^\r\n]*)", 1), F.lit(""))
    rows = written(whole.select("record_id", note("page-id").cast("long").alias("page_id"), "response.kind", "response.refers_to", "response.payload_digest", "response.payload_sha1", "response.payload_bytes"))
    again = F.col("kind") == "revisit"
    # A revisit's full payload is that of the response it names. Responses need no other's.
    named = rows.where(again).select(F.col("refers_to").alias("named")).distinct()
    first = rows.where(~again).join(named, F.col("record_id") == F.col("named"), "left_semi")
    first = written(first.groupBy(F.col("record_id").alias("first")).agg(F.max("page_id").alias("first_page"), F.max("payload_bytes").alias("first_bytes")))
    revisits = rows.where(again).join(first, F.col("refers_to") == F.col("first"), "left").select("page_id", F.col("first_bytes").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("kind").alias("record_type"), F.col("first_page").alias("refers_to"))
    responses = rows.where(~again).select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), f AS (
  SELECT page_id, html, payload_bytes,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
