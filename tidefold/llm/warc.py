"""WARC archives: a writer of response and revisit records and a reader that salvages damaged archives.

Archives are written by Spark's text writer, one record per row with the record's closing blank lines as separator, so
they go wherever Spark can write. The reader takes whole archives as rows of Spark's binaryFile source. Where a record
fails its checks it searches for the next version line (or gzip member) and goes on there; the bytes between are
returned as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import cut, new_folder, table, tidy, whole

RECORDS_PER_FILE = 1000
#: Groups of equal payloads, a digest and an id each, that are sent to all tasks at most.
BROADCAST_GROUPS = 200000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits at a time, by way of base 32 in digits and letters."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, record_type, refers_to.

    Of records with equal payloads of at least min_payload bytes the one with the largest page_id is the response, the
    others are revisits; rows that share the largest id are all responses, and null ids refer to it as well. The
    groups' winners are aggregated first and meet the payloads where these are read if there are at most
    BROADCAST_GROUPS of them, else in a sort merge join.
    """
    p = pages.select("page_id", "url", whole(F.col("html")).alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    ids = p.where(F.col("payload_bytes") >= min_payload).select("page_id", "digest")
    best = ids.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    best = cut(best)
    p = p.join(F.broadcast(best) if best.count() <= BROADCAST_GROUPS else best, "digest", "left")
    revisit = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_payload)
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("best"))).drop("best")


def record_text(p: DataFrame) -> DataFrame:
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.regexp_replace(whole(F.col("url")), r"[\x00-\x20]", "%20")
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP), F.col("payload"))).otherwise(F.lit(HTTP))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(response, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), urn("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return p.select(F.concat(head, block).alias("value"))


def write_warc(pages: DataFrame, folder: str, min_payload: int = 0) -> str:
    """Writes the rows (page_id, url, html) of `pages` as archives of at most RECORDS_PER_FILE records into `folder`."""
    out = record_text(plan_records(pages, min_payload))
    out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    return folder


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
#: What a field's name may hold, and what its value may not.
NAME, CONTROL = re.compile(rb"[!#-'*+\-.0-9A-Z^-z|~]+"), re.compile(rb"[\x00-\x08\x0A-\x1F\x7F]")
BLANK = re.compile(rb"\r\n\r\n")
START = re.compile(VERSION.pattern + b"|" + re.escape(GZIP))


def member(data: memoryview, at: int):
    """(end, bytes) of the gzip member that begins at `at`, None where it is damaged or holds no version line."""
    d, parts, upto, step = zlib.decompressobj(31), [], at, 4096
    try:
        while not d.eof and upto < len(data):
            parts.append(d.decompress(data[upto : upto + step]))
            upto, step = upto + step, min(2 * step, 1 << 20)  # what lies behind a member is copied at each, so little of it
    except zlib.error:
        return None
    raw = b"".join(parts)
    return (min(upto, len(data)) - len(d.unused_data), raw) if d.eof and VERSION.search(raw) else None


def one_record(data: memoryview, at: int):
    """(end, fields, payload) of the valid record that begins at `at`, else the reason why there is none."""
    m = VERSION.match(data, at)
    if not m:
        return "no version line"
    gap = BLANK.search(data, m.end())
    if not gap:
        return "no end of header"
    stop = gap.start()
    fields, key = {}, ""
    for line in bytes(data[m.end() : stop]).split(b"\r\n"):
        if key and line[:1] in (b" ", b"\t") and not CONTROL.search(line):  # a folded value goes on
            fields[key] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not NAME.fullmatch(name) or CONTROL.search(value):
            return "bad header line"
        key = name.lower().decode("latin-1")
        fields[key] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or not fields.get("warc-type") or not fields.get("warc-record-id"):
        return "no length, type or id"
    start = stop + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "no end of record"
    inner = BLANK.search(data, start, end)
    payload = data[inner.end() : end] if inner else data[end:end]
    said = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and said.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != said[5:]:
        return "digest differs"
    return end + 4, fields, payload


def salvage(data: bytes | memoryview, begin: int = 0, packed: bool = True):
    """Rows (kind, offset, length, fields, payload, reason) of one archive; offsets in a member count from its start.

    Records may be plain or gzipped, also within one archive. After a failed check it goes on at the earlier of the next
    version line and, if `packed`, the next gzip member."""
    at, gap, why, data = 0, None, "", memoryview(data)
    while at < len(data):
        found, inner = one_record(data, at), None
        if packed and data[at : at + len(GZIP)] == GZIP:
            inner = member(data, at)
            found = "bad gzip member" if inner is None else found
        if isinstance(found, str) and inner is None:
            gap, why = (at, found) if gap is None else (gap, why)
            m = (START if packed else VERSION).search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", begin + gap, at - gap, {}, b"", why
            gap = None
        if inner is not None:
            yield from salvage(inner[1], begin + at, False)
            at = inner[0]
            continue
        yield "record", begin + at, found[0] - at, found[1], found[2], ""
        at = found[0]
    if gap is not None:
        yield "gap", begin + gap, len(data) - gap, {}, b"", why


READ_SCHEMA = "kind string, path string, offset long, length long, record_id string, record_type string, uri string, digest string, payload_bytes long, refers_to string, reason string, payload binary"


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record (kind 'record') and per quarantined gap (kind 'gap') of the archives in `folder`.

    The digest and size of a response are computed from what was read; a revisit's are those in its header. Archives
    may be plain, gzipped by member or both. A folder of empty archives gives an empty result.
    """

    def parse(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for kind, at, n, f, payload, why in salvage(data.as_buffer()):
                    own = f.get("warc-type") == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else f.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = len(payload) if own else int(f.get("x-payload-length") or 0)
                    rows.append((kind, path, at, n, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), digest, size, f.get("warc-refers-to"), why, bytes(payload) if with_payload else None))
                    held += len(payload) if with_payload else 0
                    if held > 16 << 20:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(tidy(parse), READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_warc(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    r = read_warc(spark, folder, with_payload=False).where("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    return r.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT p.page_id, strlen(p.payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(p.h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM b.best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS NOT DISTINCT FROM b.best THEN NULL ELSE b.best END AS refers_to
FROM p JOIN b USING (h)
"""
