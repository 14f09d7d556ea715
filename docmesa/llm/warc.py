"""Writing pages as WARC archives and reading them back, with segment reassembly.

Archives hold HTTP responses in chunked transfer framing. A response longer than a segment
is continued in records that name their origin, their segment number and, in the last one, the
total length. The reader groups continuations by origin, puts them in order, checks the total
length and takes the chunked framing off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmesa.llm.common import workspace

#: Bytes of a block before it is continued, bytes of a transfer chunk, bytes of an archive before the next.
SEGMENT, CHUNK, ARCHIVE = 64 << 10, 8 << 10, 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, warc_type string, record_id string, origin string, segment int, total bigint, refers_to bigint, digest string, n bigint, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a transfer chunk does not end where it says")
        at = end + 4 + n


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(block)}.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a stream."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:20]!r}")
        fields = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = data.read(n := int(fields["content-length"]))
        if len(block) != n:
            raise ValueError("the archive ends within a record")
        yield fields, block


def urn(page_id: int | None, segment: int, copy: str = "") -> str:
    """copy: tells apart rows with the same page_id."""
    return f"<urn:page:{page_id}:{segment}{copy and ':'}{copy}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: str = "", segment: int = SEGMENT) -> Iterator[bytes]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    about = {"WARC-Target-URI": re.sub(r"\s", "%20", url) if url else None, "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http;msgtype=response"}
    same = {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": len(payload)}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield record("revisit", {"WARC-Record-ID": urn(page_id, 1, copy), **about, **same, "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": urn(refers_to, 1)}, head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        fields = {"WARC-Record-ID": urn(page_id, k, copy), **about}
        if len(parts) > 1:
            fields |= {"WARC-Segment-Number": k, "WARC-Segment-Origin-ID": urn(page_id, 1, copy) if k > 1 else None, "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}
        yield record("response" if k == 1 else "continuation", fields | same, part)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes pages (page_id bigint, url, html) to `path`: a table of gzip archives, one binary each.

    Of pages with equal payloads of at least min_bytes, that with the smallest page_id is a
    response and the others revisit it. Null html is an empty payload. Rows with a null page_id
    are responses, as are further rows of the smallest page_id itself.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.select("page_id", F.sha2("html", 256).alias("key"), F.octet_length("html").alias("n")).filter(F.col("page_id").isNotNull() & (F.col("n") >= min_bytes))
    groups = keyed.groupBy("key", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("key", "n", "first")
    later = keyed.join(groups, ["key", "n"]).filter("page_id != first").select("page_id", "key", "n", "first").distinct()
    # payloads do not move: the ids of revisits do, and where few enough they are broadcast at run time
    full = pages.withColumn("key", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    ready = full.join(later, ["page_id", "key", "n"], "left").select("page_id", "url", "html", "first")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, size, done, task = io.BytesIO(), 0, 0, TaskContext.get().partitionId()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                done += 1
                for r in page_records(row[0], row[1], row[2].encode(), row[3], f"{task}-{done}"):
                    raw.write(gzip.compress(r, 4, mtime=0))
                    size += len(r)
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array([raw.getvalue()], pa.binary())], names=["archive"])
                    raw, size = io.BytesIO(), 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([raw.getvalue()], pa.binary())], names=["archive"])

    ready.mapInArrow(archives, "archive binary").write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, see RECORDS; whole responses have their block as payload already."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x not in (None, "None") else None
        page = lambda x: number(x.split(":")[2]) if x else None
        schema = pa.schema([("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("block", pa.binary())])
        for b in batches:
            for data in b.column(0).to_pylist():
                out: list[dict] = []
                for f, block in records(gzip.GzipFile(fileobj=io.BytesIO(data))):
                    get = f.get
                    out.append({"page_id": page(get("warc-record-id")), "warc_type": get("warc-type"), "record_id": get("warc-record-id"), "origin": get("warc-segment-origin-id"), "segment": number(get("warc-segment-number")), "total": number(get("warc-segment-total-length")), "refers_to": page(get("warc-refers-to")), "digest": get("warc-payload-digest", "").removeprefix("sha1:"), "n": number(get("x-payload-length")), "block": block})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return archives.select("archive").mapInArrow(rows, RECORDS)


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


def reassemble(found: DataFrame) -> DataFrame:
    """Payloads of the response records: page_id, record_id, warc_type, refers_to, digest, n (payload bytes), payload.

    A record that is not continued is decoded where it was read. Only segments are shuffled, by the
    record they continue; a response is one document, so its segments fit a task. A missing
    segment, a wrong total length or a wrong digest raises an error. Revisits have no payload.
    """
    whole = found.filter(F.col("segment").isNull())
    parts = found.filter(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))
    joined = parts.groupBy("origin", "page_id").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("p"), F.max("total").alias("total"), F.max("digest").alias("digest"), F.max("n").alias("n"))
    in_order = F.transform("p", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("p"))
    sized = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["block"])) == F.col("total")
    blocks = F.when(in_order & sized, F.transform("p", lambda x: x["block"])).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), "origin")))
    one = joined.select("page_id", F.col("origin").alias("record_id"), F.lit("response").alias("warc_type"), F.lit(None).cast("bigint").alias("refers_to"), "digest", "n", blocks.alias("blocks"))
    every = whole.select("page_id", "record_id", "warc_type", "refers_to", "digest", "n", F.array("block").alias("blocks")).unionByName(one)
    return every.mapInArrow(_decoded, "page_id bigint, record_id string, warc_type string, refers_to bigint, digest string, n bigint, payload binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = []
        for kind, digest, n, blocks in zip(*(b.column(i).to_pylist() for i in (2, 4, 5, 6)), strict=True):
            payload = payload_of(b"".join(blocks)) if kind == "response" else None
            if payload is not None and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError("a payload does not have its record's length and digest")
            payloads.append(payload)
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(payloads, pa.binary())], names=["page_id", "record_id", "warc_type", "refers_to", "digest", "n", "payload"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and lists what is read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit has the length and digest of what it refers to."""
    path = workspace(pages.sparkSession, "warc")
    write_archives(pages, path)
    back = reassemble(read_records(pages.sparkSession.read.schema("archive binary").parquet(path)))
    size = F.coalesce(F.octet_length("payload").cast("bigint"), "n")
    return back.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")
