"""WARC archives with repeated payloads written once.

Headers (id, url, digest, length) are shuffled by payload digest; of equal payloads one record is the response and the
others become revisit records that refer to it. A revisit is written from its header alone, a response where its
payload was read, so payloads are not shuffled by digest. Every record is a gzip member of its own, so a reader can
start at any record. Spark's text writer puts the members down one after the other, with an empty gzip member as its
line separator, so any Hadoop file system works.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, few_rows, fresh_path, remove

CRLF = "\r\n"
END = CRLF * 2
#: A gzip member that holds nothing: between records it changes nothing.
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0)
#: Revisit records that are broadcast to drop them from the responses (about 40 bytes each).
BROADCAST_ROWS = 200_000
MIN_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to: which records carry their payload.

    Of equal payloads of at least min_bytes bytes, that of the largest page_id is the response and the
    others are revisits of it (their payload is null here); all smaller ones are responses and are not shuffled. A null
    payload is empty, a null url is written as an empty URI. Rows that share the largest page_id are all responses. A null
    page_id is below every other; if a payload has null ids only, they are responses. Very long payloads are written
    whole. Extra columns are not read; an empty table gives no rows.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    headers = rows.where(F.col("payload_bytes") >= min_bytes).drop("payload")
    # Counted by digest in each task first, so a hot payload is a few rows.
    first = headers.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeats = headers.join(first, "payload_digest").where("NOT page_id <=> first")
    revisits = cut(repeats.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to")), "revisits")
    # A row is a revisit if its id and digest are; beyond a broadcast, rows meet by id, which no payload makes hot.
    gone = few_rows(revisits.select(F.col("page_id").alias("gone"), F.col("payload_digest").alias("gone_digest")), BROADCAST_ROWS)
    left = rows.join(gone, F.col("page_id").eqNullSafe(F.col("gone")) & (F.col("payload_digest") == F.col("gone_digest")), "left_anti")
    responses = left.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


def _uuid(key):
    h = F.md5(F.concat(F.lit("page "), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.concat(F.lit("urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)))


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """WARC 1.1 records with fresh headers, a gzip member each, in archive files under path.

    Every record has Content-Length of its own block; X-Page-Id keeps the row's id (absent if null). A file holds the
    records of a task, so files are as large as the pieces in which Spark reads the pages. An empty table writes no record.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x.as_py(), 6, mtime=0) for x in batch.column(0)], pa.binary())], names=["value"])

    url = F.regexp_replace("url", "[\r\n]", " ")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    head = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<"), _uuid(F.col("page_id")), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(F.col("record_type") == "revisit", F.concat(F.lit("<"), _uuid(F.col("refers_to")), F.lit(">")))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in head]
    record = F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), block, F.lit(END)).cast("binary")
    members = resolved.select(record.alias("value")).mapInArrow(run, "value binary")
    # A binary cast to a string keeps its bytes; Latin-1 keeps those of the separator.
    members.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


#: Compressed bytes that are looked at together; what follows a member in them is copied.
STEP = 1 << 14


def members(raw: bytes):
    """(offset, contents) of each gzip member of a file; work is in proportion to its length, however many there are."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        start, unzip, parts = at, zlib.decompressobj(31), []
        while not unzip.eof:
            piece = view[at : at + STEP]
            if not piece:
                raise ValueError("cut off WARC record")
            parts.append(unzip.decompress(piece))
            at += len(piece)
        at -= len(unzip.unused_data)
        yield start, b"".join(parts)


FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)")


def records(raw: bytes):
    """(fields, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        fields = {k.decode().lower(): v.decode() for k, v in FIELD.findall(raw, at, body)}
        end = body + int(fields["content-length"])
        if raw[at:at + 5] != b"WARC/" or raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError("broken WARC record")
        yield fields, raw[body:end]
        at = end + 4


def read_archives(spark, path: str) -> DataFrame:
    """record_id, page_id, record_type, refers (record id or null), digest and the block's bytes and SHA-1, per record.

    A record without X-Page-Id gets a null page_id; a broken one raises. A folder without records gives no rows."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for f, block in (r for _, one in members(raw.as_py()) for r in records(one)):
                    rows.append({"record_id": f["warc-record-id"], "page_id": int(f["x-page-id"]) if "x-page-id" in f else None, "record_type": f["warc-type"], "refers": f.get("warc-refers-to"), "digest": f["warc-payload-digest"].removeprefix("sha1:"), "block_bytes": len(block), "block_sha1": hashlib.sha1(block).hexdigest()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("block_bytes", pa.int64()), ("block_sha1", pa.string())]))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id long, record_type string, refers string, digest string, block_bytes long, block_sha1 string")


def follow(read: DataFrame) -> DataFrame:
    """Each record with its full payload's length and digest; revisits are joined to the responses they refer to.

    A revisit whose response is not there keeps its digest and gets a null length and refers_to."""
    responses = read.where("record_type = 'response'")
    # Rows that repeat a page_id share a record id and payload digest: one row each.
    originals = responses.groupBy(F.col("record_id").alias("refers"), F.col("block_sha1").alias("digest")).agg(F.first("page_id").alias("refers_to"), F.first("block_bytes").alias("bytes"))
    plain = responses.select("page_id", F.col("block_bytes").alias("payload_bytes"), F.col("block_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read.where("record_type = 'revisit'").join(originals, ["refers", "digest"], "left")
    return plain.unionByName(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    read = cut(read_archives(spark, path), "records")
    remove(spark, path)
    return follow(read)


def sql() -> str:
    """DuckDB SQL for op5_warc_revisits."""
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> top THEN top END AS refers_to FROM f"""
