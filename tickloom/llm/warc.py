"""WARC archives: written with an index, read back by coalesced byte ranges.

Every task that writes opens its own archives, one gzip member per record, and
returns the index rows: archive, offset, length, URL and digest. Only the index of
tasks that succeeded is stored, so archives of lost or repeated tasks are never
read. Readers select records in the index, gather them by archive and byte range,
and read neighbouring records with one sorted, coalesced read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, read, scratch_dir, stored, text_of

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"
_INDEX = "archive string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to {id}"
_RECORD = "url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, html string"


def _fs(uri: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``id, digest, refers_to`` of the records that repeat a payload."""
    meta = stored(
        pages.select(
            F.col(id_col).alias("id"),
            F.sha2(F.encode(text_of(html_col), "UTF-8"), 256).alias("digest"),
            F.octet_length(text_of(html_col)).alias("bytes"),
        ).where(F.col("bytes") >= min_bytes),
        "warc-meta",
    )
    firsts = meta.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = stored(firsts, "warc-firsts")
    return stored(
        meta.join(broadcast_if_small(firsts), "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct(),
        "warc-revisits",
    )


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + _CRLF + _CRLF


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Archive:
    def __init__(self, root: str):
        self.uri = f"{root}/{uuid.uuid4().hex}.warc.gz"
        fs, path = _fs(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at = fs.open_output_stream(path, compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)


def write_warc(
    pages: DataFrame,
    root: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Writes one record per row below ``root``, and returns the stored index.

    A null page is an empty payload, a null URL leaves the header out. Of rows that
    repeat a payload of at least ``min_revisit_bytes``, those with the smallest id
    are responses and the others revisit it; a null id is always a response.
    Columns other than the three are ignored. An empty table gives an empty index.
    """
    root = root or scratch_dir(pages.sparkSession, "warc")
    ids = dict(pages.dtypes)[id_col]
    again = revisits(pages, id_col, html_col, min_revisit_bytes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).join(broadcast_if_small(again), ["id", "digest"], "left")
    rows = rows.select("id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if archive is None or archive.at >= roll_bytes:
                    if archive:
                        archive.out.close()
                    archive = _Archive(root)
                payload = r["html"].encode()
                at, length = archive.add(_gzip(_record(r["id"], r["url"], payload, r["digest"], r["refers_to"], date)))
                kind = "response" if r["refers_to"] is None else "revisit"
                out.append({"id": r["id"], "archive": archive.uri, "offset": at, "length": length, "url": r["url"], "digest": r["digest"], "payload_bytes": len(payload), "record_type": kind, "refers_to": r["refers_to"]})
            yield pa.RecordBatch.from_pylist(out, schema=index_schema(batch.schema.field("id").type))
        if archive:
            archive.out.close()

    return stored(rows.mapInArrow(write, f"id {ids}, " + _INDEX.format(id=ids)), "warc-index")


def index_schema(kind: pa.DataType) -> pa.Schema:
    s, n = pa.string(), pa.int64()
    return pa.schema([("id", kind), ("archive", s), ("offset", n), ("length", n), ("url", s), ("digest", s), ("payload_bytes", n), ("record_type", s), ("refers_to", kind)])


def _parse(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(_CRLF * 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_CRLF * 2)
    length = int(re.search(rb"\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    found = {"url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None, "html": None}
    if found["record_type"] == "revisit":
        found["refers_to"] = fields["WARC-Refers-To"][len("<urn:page:") : -1]
    else:
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        found["html"] = payload.decode()
    return {"id": fields["WARC-Record-ID"][len("<urn:page:") : -1] or None} | found


def read_warc(index: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES, with_html: bool = True) -> DataFrame:
    """The records that ``index`` selects: ``id, url, payload_bytes,
    payload_digest, record_type, refers_to, html`` (null for revisits).

    Records are gathered by archive and range of ``range_bytes``; inside a range,
    records at most ``gap_bytes`` apart are read together. Payloads are checked
    against their digest."""
    ids = dict(index.dtypes)["id"]
    ranges = index.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("range")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))

    def spans(records: list[dict]) -> Iterator[list[dict]]:
        span: list[dict] = []
        for r in records:
            if span and r["offset"] - span[-1]["offset"] - span[-1]["length"] > gap_bytes:
                yield span
                span = []
            span.append(r)
        if span:
            yield span

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = pa.string()
        schema = pa.schema([("id", s), ("url", s), ("payload_bytes", pa.int64()), ("payload_digest", s), ("record_type", s), ("refers_to", s), ("html", s)])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _fs(row["archive"])
                with fs.open_input_file(path) as f:
                    for span in spans(row["records"]):
                        start, end = span[0]["offset"], span[-1]["offset"] + span[-1]["length"]
                        f.seek(start)
                        data = f.read(end - start)
                        found = [_parse(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in span]
                        if not with_html:
                            found = [x | {"html": None} for x in found]
                        yield pa.RecordBatch.from_pylist(found, schema=schema)

    out = ranges.mapInArrow(fetch, "id string, " + _RECORD.format(id="string"))
    return out.withColumn("id", F.col("id").cast(ids)).withColumn("refers_to", F.col("refers_to").cast(ids))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, as read back from their archives."""
    index = write_warc(read(spark, sf_dir, "pages"))
    return read_warc(index, with_html=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
QUERIES = {"op3_warc": op3_warc}
