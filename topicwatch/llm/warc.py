"""WARC archives: writing with revisits and segments, and segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code
from .common import materialize, text_or_empty

CRLF = b"\r\n"
#: Types of records that hold a page; others (``warcinfo``, ``request``, ``metadata``) are skipped.
PAGE_KINDS = ("response", "revisit", "continuation")
#: Fixed values of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Transfer-Encoding: chunked\r\n\r\n")
RECORD = ("id string, uri string, type string, payload_digest string, refers_to string, full_length long, "
          "segment int, origin string, total_length long, block binary")


def quoted(text: str) -> str:
    """``text`` as one header line: line ends and ``%`` are percent-encoded."""
    return re.sub("[%\r\n]", lambda m: f"%{ord(m[0]):02X}", text)


def unquoted(text: str | None) -> str | None:
    return text and re.sub("%(25|0D|0A)", lambda m: chr(int(m[1], 16)), text)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n:end + 4 + n] != CRLF:
            raise ValueError("chunk is cut short")
        at = end + 4 + n


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page: str, uri: str, date: str, payload: bytes, sha1: bytes, first: str, segment_bytes: int,
                 chunk_bytes: int) -> list[bytes]:
    """The records of one page: a response, cut into segments if its block is longer
    than ``segment_bytes``, or a revisit of page ``first``."""
    record_id = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", "sha1:" + base32_sha1(sha1)), ("X-Page-ID", quoted(page)),
              ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if first != page:
        return [_record("revisit", fields + [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", quoted(first))], HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record("response", fields, block)]
    out = []
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at:at + segment_bytes]
        own = fields if n == 1 else [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Segment-Origin-ID", record_id)]
        own = own + [("WARC-Segment-Number", str(n))]
        if at + segment_bytes >= len(block):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record("response" if n == 1 else "continuation", own, part))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0, segment_bytes: int = 16_384,
               chunk_bytes: int = 4_096, records_per_file: int = 4_000, compression: str = "gzip") -> None:
    """Write one WARC record per row (a long response as several segments) under ``path``.

    Of rows with equal payloads (UTF-8 of the body, null: empty) of at least
    ``min_revisit_bytes`` bytes, the one with the smallest id is the response, the
    others are revisits of it. The smallest id per payload is a partial
    aggregate; it is written and joined back as a plain table, so that the
    adaptive skew join can split a payload that a third of all rows share.
    Spark's text writer writes the files: the two line ends that close a record
    are its line separator, so a task's file is committed as a whole on any file
    system. Line ends in ids are percent-encoded and come back on reading. Null ids and urls are written as empty; rows without an id or that
    repeat an id and its payload are responses of their own. A file holds at most
    ``records_per_file`` records and is compressed as a whole ("gzip" or "none").
    """
    ship_code(pages.sparkSession)
    body = F.encode(text_or_empty(body_col), "UTF-8")
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("page"),
                        F.col(f"`{id_col}`").alias("id"), text_or_empty(url_col).alias("uri"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    large = F.col("n") >= min_revisit_bytes
    firsts = materialize(rows.where(large).groupBy("sha1", "n").agg(F.min("id").cast("string").alias("first")), "payloads")
    rows = rows.join(firsts, ["sha1", "n"], "left").select(
        "page", "uri", F.when(F.col("first").isNull() | F.col("id").isNull(), F.col("page")).otherwise(F.col("first")).alias("first"),
        F.unhex("sha1").alias("sha1"), "payload")

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            out = []
            for page, uri, first, sha1, payload in zip(*[c.to_pylist() for c in batch.columns]):
                uri = re.sub(r"[\r\n]+", " ", uri)  # a header field is one line
                out += page_records(page, uri, date, payload, sha1, first, segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
     .option("compression", compression).text(path))


def parse_records(data: memoryview, segmented: bool) -> Iterator[tuple]:
    """The records of one archive as ``RECORD`` rows: segments of longer records,
    or else the whole records. Blocks of the other kind are skipped by their length."""
    at, end = 0, len(data)
    while at < end:
        stop = at
        while (head := bytes(data[at:stop + 4096])).find(b"\r\n\r\n") < 0:
            stop += 4096
            if stop > end:
                raise ValueError("record head is cut short")
        size = head.index(b"\r\n\r\n")
        # field names are case-insensitive, the blank after the colon may be missing
        lines = (line.partition(":") for line in head[:size].decode("utf-8", "replace").split("\r\n")[1:])
        fields = {name.strip().lower(): value.strip(" \t") for name, _, value in lines}
        start, n = at + size + 4, int(fields["content-length"])
        if start + n + 4 > end:
            raise ValueError("record block is cut short")
        segment, kind = fields.get("warc-segment-number"), fields.get("warc-type", "").lower()
        if (segment is not None) == segmented and kind in PAGE_KINDS:
            total = fields.get("warc-segment-total-length")
            record_id = fields["warc-record-id"]
            digest = fields.get("warc-payload-digest")
            length = fields.get("x-payload-length")
            yield (unquoted(fields.get("x-page-id")), fields.get("warc-target-uri"), kind,
                   digest and digest.removeprefix("sha1:"), unquoted(fields.get("x-refers-to-page")),
                   int(length) if length else None,
                   int(segment or 1), fields.get("warc-segment-origin-id", record_id),
                   int(total) if total else None, data[start:start + n].tobytes())
        at = start + n + 4


def archive_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """All records of the archives under ``path``, segments or whole records."""
    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in RECORD.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                if bytes(data[:2]) == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = parse_records(memoryview(data), segmented)
                while part := [r for _, r in zip(range(500), rows)]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records of their segments: grouped by origin, in order of the segment
    number, with the total length verified. A record whose numbers have a gap or
    whose length differs has ``block`` null. A group is one record's block."""
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block")))
    # only the origin's own record has the page's fields
    whole = segments.groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("id", "uri", "payload_digest", "refers_to", "full_length", "total_length")],
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), ordered.alias("parts"))
    block = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["block"]))
    complete = (F.element_at("parts", -1)["segment"] == F.size("parts")) & (F.octet_length("_block") == F.col("total_length"))
    return (whole.withColumn("_block", block)
            .withColumn("block", F.when(complete, F.col("_block"))).withColumn("segment", F.lit(1))
            .select(*[f.split()[0] for f in RECORD.split(", ")]))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The pages of the archives under ``path``.

    Whole records are decoded where they are read. Segments alone are shuffled,
    by the origin's identifier, put in order, checked against the total length
    and joined. A response's payload is its HTTP body without chunked transfer
    framing; its digest is made from that payload. A revisit takes length and
    digest from its own fields.

    Returns ``page_id`` (string), ``uri``, ``record_type``, ``payload_bytes``,
    ``payload_digest`` (bare upper-case base32 SHA-1), ``refers_to``, ``valid``
    (false if the record is incomplete or the digest differs; never dropped)
    and, with ``payloads``, ``payload`` (null for revisits).
    """
    ship_code(spark)
    records = archive_records(spark, path, False).unionByName(reassembled(archive_records(spark, path, True)))
    schema = ("page_id string, uri string, record_type string, payload_bytes long, payload_digest string, "
              "refers_to string, valid boolean" + (", payload binary" if payloads else ""))

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload, n, digest, valid = None, r["full_length"], r["payload_digest"], r["block"] is not None
                if r["type"] == "response" and valid:
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    n, digest = len(payload), base32_sha1(hashlib.sha1(payload).digest())
                    valid = digest == r["payload_digest"]
                row = (r["id"], r["uri"], r["type"], n, digest, r["refers_to"], valid)
                out.append(row + (payload,) if payloads else row)
            types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.binary()] * payloads
            names = [f.split()[0] for f in schema.split(", ")]
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return records.mapInArrow(decode, schema)
