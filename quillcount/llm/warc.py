"""WARC archives: records written and read back, segments reassembled.

Writing goes through Spark's text writer with two CRLFs as the separator, which
is how WARC ends a record, so archives are committed like any other output and
a lost executor's files never count. A response whose HTTP message is longer
than ``SEGMENT_BYTES`` is written as a first segment and continuation records.
Reading parses archives by content length, groups the segments of a record by
their origin's id, orders them by segment number, checks that none is missing
and that their total length is the one stated, and decodes the HTTP message's
chunked transfer framing.

Of records with equal payloads the one with the largest page_id is the
response, the others are revisits that name it; equal payloads are found by
partial maxima per digest, so a payload shared by a third of all pages is not
gathered.

Defined results: a null html is an empty payload; of repeated rows of one
page_id and payload one is the response and the others revisit it; a null
page_id is written without that field, comes last in the choice of the response
and is read back as null; an empty table writes no record; a record that fails
its checks has a ``problem`` and no payload; very long pages become as many
segments as they need; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configured, shared_dir, staged, table

#: Bytes of an HTTP message that one record holds; payloads at least this long revisit equal ones.
SEGMENT_BYTES, LEAST_REVISIT = 32_768, 0
#: Bytes of a chunk of the transfer coding, and records of an archive file.
CHUNK_BYTES, ARCHIVE_RECORDS = 8_192, 400

_END = "\r\n"
_NAMESPACE = uuid.UUID("b6c5a9f0-2d7b-4b58-9d0e-6a2f52f0c0de")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, page_id long, uri string, refers_to string, digest string, number int, origin string, total long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, row: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{row}:{digest}')}>"


def _parts(data: bytes, size: int) -> list[bytes]:
    """``data`` in parts of about ``size`` bytes that end between characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _parts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def records(page_id, row: int, url: str | None, payload: bytes, refers: tuple | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The WARC records of one page, without their closing CRLFs. ``refers``: (page_id, row) of the response."""
    digest = base32_sha1(payload)
    own = record_id(page_id, row, digest)
    common = ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}"]
    if page_id is not None:
        common.append(f"Page-Id: {page_id}")

    def record(fields: list[str], block: bytes) -> bytes:
        return (_END.join(["WARC/1.1", *fields, f"Content-Length: {len(block)}"]) + _END * 2).encode() + block

    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        fields = ["WARC-Type: revisit", f"WARC-Record-ID: {own}", *common, f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(*refers, digest)}"]
        fields += [] if refers[0] is None else [f"Refers-To-Page-Id: {refers[0]}"]
        return [record([*fields, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"], f"{head}Content-Length: {len(payload)}\r\n\r\n".encode())]
    message = (head + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    parts = _parts(message, segment)
    fields = ["WARC-Type: response", f"WARC-Record-ID: {own}", *common, f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if len(parts) == 1:
        return [record(fields, message)]
    out = [record([*fields, "WARC-Segment-Number: 1"], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = ["WARC-Type: continuation", f"WARC-Record-ID: {record_id(page_id, row, f'{digest}:{k}')}", *common, f"WARC-Segment-Origin-ID: {own}", f"WARC-Segment-Number: {k}"]
        out.append(record(more + ([f"WARC-Segment-Total-Length: {len(message)}"] if k == len(parts) else []), part))
    return out


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Write a record, or its segments, for each row of ``pages`` (page_id, url, html)."""
    configured(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "sha": F.sha1(F.col("html").cast("binary"))})
    equal = rows.where(F.octet_length("html") >= least_revisit).groupBy("sha").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count("*").alias("n"))
    equal = staged(equal.where("n > 1").select("sha", F.col("top.page_id").alias("top_page"), F.col("top.row").alias("top_row")), "warc-equal")
    rows = rows.join(equal, "sha", "left").select("page_id", "row", "url", "html", "top_page", "top_row")

    def run(batches):
        for batch in batches:
            out: list[bytes] = []
            for page, row, url, html, top_page, top_row in zip(*(c if c.type == pa.string() else c.to_pylist() for c in batch.columns), strict=True):
                refers = None if top_row is None or top_row == row else (top_page, top_row)
                out += records(page, row, url.as_py(), html.as_py().encode(), refers)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    text = rows.mapInArrow(run, "value string").write.option("lineSep", _END * 2).option("compression", "gzip")
    text.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)$", re.M)


def parse(archive: bytes):
    """(fields, block) of the records of an archive, by content length."""
    data = archive
    if data[:2] == b"\x1f\x8b":  # one gzip member or several
        out = []
        while data:
            member = zlib.decompressobj(31)
            out.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = {k.lower().decode(): v.decode() for k, v in _FIELD.findall(data[at:end].replace(b"\r\n", b"\n"))}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record without its end")
        at += 4


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """A row (RECORD) per record of the archives under ``path``, segments apart; a record that is
    not segmented has no number. An archive is read whole, so it has to be below 2 GB."""
    configured(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                columns: list[list] = [[] for _ in range(10)]
                for f, block in parse(content.as_py()):
                    page, total = f.get("page-id"), f.get("warc-segment-total-length")
                    number = f.get("warc-segment-number", 1 if f["warc-type"] == "continuation" else None)
                    values = (f["warc-record-id"], f["warc-type"], page and int(page), f.get("warc-target-uri"), f.get("refers-to-page-id"), f.get("warc-payload-digest"),
                              number and int(number), f.get("warc-segment-origin-id", f["warc-record-id"]), total and int(total), block)
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, page_id, uri, refers_to, digest, payload_bytes, payload, problem): whole records.

    ``digest`` is the payload's, recomputed for responses; a revisit has its
    response's digest and length, and no payload.
    """
    found = staged(archive_records(spark, path), "warc-records")
    names = ("type", "page_id", "uri", "refers_to", "digest")
    # only segments are shuffled: records of their own are whole already
    single = found.where("number IS NULL").select(F.col("origin").alias("record_id"), *names, F.array(F.lit(1)).alias("numbers"), F.array("block").alias("blocks"), "total")
    part = F.struct("number", "block", "total", *names)
    whole = found.where("number IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    first = F.col("parts")[0]
    whole = single.unionByName(whole.select(
        F.col("origin").alias("record_id"), *[first[c].alias(c) for c in names],
        F.col("parts.number").alias("numbers"), F.col("parts.block").alias("blocks"), F.element_at("parts", -1)["total"].alias("total"),
    ))

    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            digests, sizes, payloads, problems = [], [], [], []
            for kind, stated, numbers, blocks, total in zip(c["type"].to_pylist(), c["digest"].to_pylist(), c["numbers"].to_pylist(), c["blocks"], c["total"].to_pylist(), strict=True):
                message = b"".join(blocks.as_py())
                payload, problem, digest, size = None, None, (stated or "").removeprefix("sha1:"), None
                try:
                    if numbers != list(range(1, len(numbers) + 1)) or kind == "continuation":
                        raise ValueError("a segment is missing or repeated")
                    if len(numbers) > 1 and total != len(message):
                        raise ValueError("the segments' total length is not the one stated")
                    head, _, body = message.partition(b"\r\n\r\n")
                    fields = {k.lower(): v for k, v in _FIELD.findall(head.replace(b"\r\n", b"\n"))}
                    if kind == "response":
                        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                        size = len(payload)
                        if base32_sha1(payload) != digest:
                            payload = None
                            raise ValueError("the payload's digest is not the one stated")
                    elif b"content-length" in fields:
                        size = int(fields[b"content-length"])
                except ValueError as error:
                    problem = str(error)
                for to, v in zip((digests, sizes, payloads, problems), (digest, size, payload, problem), strict=True):
                    to.append(v)
            kept = [c[n] for n in ("record_id", "type", "page_id", "uri", "refers_to")]
            made = [pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names=["record_id", "type", "page_id", "uri", "refers_to", "digest", "payload_bytes", "payload", "problem"])

    kinds = "record_id string, type string, page_id long, uri string, refers_to string, digest string, payload_bytes long, payload binary, problem string"
    return whole.mapInArrow(run, kinds)


def op4_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/staged/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = read_archives(spark, path)
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), "problem")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT h, max(page_id) AS t FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(p.h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = t THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = t THEN NULL ELSE t END AS refers_to, NULL::VARCHAR AS problem
FROM p JOIN top ON p.h = top.h
"""
