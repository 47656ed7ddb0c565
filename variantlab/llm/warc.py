"""WARC archives with revisit resolution.

Headers (ids, digests and lengths) are shuffled by payload digest; the smallest page_id of a digest is the response,
the others become revisit records that refer to it. What was decided is joined back by page_id and digest, so a digest
that very many pages share is no hot key for their payloads, which travel only where the revisits are too many to
broadcast. Archives are files of gzip members, one or more for each record, each file with a warcinfo record first and
of a bounded number of payload bytes. They are written by Spark's text writer, so they go wherever Spark can write: a
member's last byte is the highest of its length, 0 below 16 MB, and is written as the line separator; longer records
are several members. They are read back file by file, record by record.

Defined results: null html is an empty payload; payloads of fewer than least bytes are all responses; a null page_id
is written as an empty number and comes back null, and sorts after all others; a null url is an empty target;
rows that repeat the id of a digest's response are responses too; very long html is one record, of several members;
other columns are ignored; an empty table writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import keyed, stored

#: A file ends with the record that brings its payloads to this many bytes.
FILE_BYTES = 32 << 20
_MEMBER = (1 << 24) - 1
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_PLACE, f'{page_id} {url}')}>"


def _uri(url: str | None) -> str:
    """url with controls and spaces percent-encoded, so that it stays on its line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def digested(pages: DataFrame) -> DataFrame:
    """pages with payload (html or empty text), payload_bytes and sha1, the digest in hexadecimal."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """The revisits among headers (page_id, url, payload_bytes, sha1): no_id, id (page_id or 0), sha1, refers_to, refers_url."""
    headers = headers.where(F.col("payload_bytes") >= least).select(F.col("page_id").isNull().alias("no_id"), F.coalesce("page_id", F.lit(0)).alias("id"), "url", "sha1")
    same = headers.groupBy("sha1").agg(F.min(F.struct("no_id", "id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1 AND NOT first.no_id")
    each = keyed(headers.select("no_id", "id", "sha1").distinct(), same.select("sha1", "first"), "sha1", "inner")
    return each.where("no_id OR id <> first.id").select("no_id", "id", "sha1", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def _members(data: bytes) -> bytes:
    """data as gzip members of less than 16 MB each, so that each ends in a zero byte."""
    return b"".join(gzip.compress(data[at : at + _MEMBER], 6, mtime=0) for at in range(0, len(data), _MEMBER))


def _info(date: str, seed: str) -> bytes:
    block = "software: variantlab\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_PLACE, seed)}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", block]
    return ("\r\n".join(head) + _END).encode()


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html), equal payloads once, in files of about file_bytes of payload."""
    rows = digested(pages).withColumn("no_id", F.col("page_id").isNull()).withColumn("id", F.coalesce("page_id", F.lit(0)))
    joined = keyed(rows, resolve(rows, least), ["no_id", "id", "sha1"], "left")

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        part, held, seq = 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                parts, values, seqs = [], [], []
                for r in batch.slice(at, 64).to_pylist():
                    revisit = r["refers_to"] is not None and r["payload_bytes"] >= least
                    block = (_HTTP.format(r["payload_bytes"]) + ("" if revisit else r["payload"])).encode()
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(r['page_id'], r['url'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(r['url'])}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-ID: {'' if r['page_id'] is None else r['page_id']}"]
                    if revisit:
                        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(r['refers_to'], r['refers_url'])}", f"WARC-Refers-To-Target-URI: {_uri(r['refers_url'])}", f"WARC-Refers-To-Date: {date}"]
                    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
                    if held == 0:
                        for column, v in zip((parts, seqs, values), (part, seq, _members(_info(date, f"{task}/{part}"))[:-1]), strict=True):
                            column.append(v)
                        seq += 1
                    for column, v in zip((parts, seqs, values), (part, seq, _members("\r\n".join(head).encode() + block + _END.encode())[:-1]), strict=True):
                        column.append(v)
                    seq, held = seq + 1, held + (0 if revisit else r["payload_bytes"]) + 512
                    if held >= file_bytes:
                        part, held = part + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(seqs, pa.int64()), pa.array(values, pa.binary())], names=["part", "seq", "value"])

    members = joined.select("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to", "refers_url").mapInArrow(run, "part int, seq long, value binary")
    ordered = members.sortWithinPartitions("part", "seq").select("part", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("part").option("lineSep", "\0").option("compression", "none").text(path)


def records(file):
    """(headers, block) of each record of an archive read from a binary file, headers by lower-case name."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        head = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = file.read(int(head["content-length"]))
        if file.read(4) != _END.encode():
            raise ValueError(f"a record without end: {head['warc-record-id']}")
        yield head, block


_READ = "page_id long, record_type string, record_id string, target string, refers_record string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit of the archives; a revisit's payload is null, and its payload_bytes are those its HTTP headers state."""

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _READ.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                data = io.BytesIO(content.as_py())
                rows = []
                for head, block in records(gzip.GzipFile(fileobj=data) if data.getbuffer()[:2] == b"\x1f\x8b" else data):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind = head["warc-type"]
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, payload = len(body), body
                        if payload_digest(body) != stated:
                            raise ValueError(f"payload and digest differ in {head['warc-record-id']}")
                    else:
                        size, payload = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0]), None
                    rows.append((int(head["warc-page-id"]) if head.get("warc-page-id") else None, kind, head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-refers-to"), stated, size, payload))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, _READ)


def resolved(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record; revisits are joined to their responses."""
    rows = stored(archive.select("page_id", "record_type", "record_id", "refers_record", "payload_digest", "payload_bytes"), "records")
    revisits = rows.where("record_type = 'revisit'")
    asked = revisits.select(F.col("refers_record").alias("record_id")).distinct()
    origin = keyed(rows.where("record_type = 'response'"), asked, "record_id", "left_semi").groupBy("record_id", F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("full"))
    joined = keyed(revisits.withColumnRenamed("record_id", "own").withColumnRenamed("refers_record", "record_id"), origin, "record_id", "left").where("digest IS NULL OR digest = payload_digest")
    first = rows.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(joined.select("page_id", F.coalesce("full", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
