"""WARC archives with an index: write, select, and read back by byte ranges.

Writing: each task writes one archive of its rows, each record a gzip member of its own, and
reports file, offset, length, URL and digest of every record; this index is a table. Reading: the selected index rows are sorted by
file and offset, near ranges are joined into one read, and the records are parsed from it.

Among records with equal payloads the one with the largest page id is a response, and the others
are revisits of it; payloads under ``min_bytes`` are always responses. Tasks write under names of
their own, so archives of lost attempts are in no index and never read.

Defined results: a null html is an empty payload; a null URL is written as ``about:blank``; a null
page id is smaller than all others; repeated rows that share the largest page id of their payload
are all responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginmart.llm import _common

#: Fixed value of the record date: results must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Gap in bytes over which two ranges of a file are still one read, and bytes of one read.
READ_GAP, READ_BYTES = 64 << 10, 8 << 20
#: gzip level of the records.
LEVEL = 1
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    # Line ends and spaces of a URL cannot stand in a header.
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, type, page ids and payload of a record; for a revisit, the payload's length is its HTTP header's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
    page = lambda name: None if (v := headers.get(name, "<urn:page:null>")[10:-1]) in ("null", "None") else int(v)
    out = {"page_id": page("WARC-Record-ID"), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload, "payload_bytes": said, "payload_digest": headers["WARC-Payload-Digest"][5:]}
    if out["record_type"] == "response" and (len(payload) != said or sha1_base32(payload) != out["payload_digest"]):
        raise ValueError("a payload differs from its digest")
    return out


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write page_id, url, html rows as archives; returns the index, staged."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    same = F.sha2("html", 256)
    # Counted with partial sums in each task, and written: both sides of the join are then plain
    # shuffles, and the rows of a payload that fills a third of the table can be split over tasks.
    kept = rows.groupBy(same.alias("_same")).agg(F.max(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("_response"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    kept = _common.staged(kept, "warc-copies")
    plan = rows.withColumn("_same", same).join(kept, "_same", "left").drop("_same")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _common.filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = uuid.uuid4().hex + ".warc.gz", None, 0
        for batch in _common.slices(batches, "html"):
            index: list[tuple] = []
            for page_id, url, html, response in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = html.encode()
                digest = sha1_base32(payload)
                own = -(1 << 63) if page_id is None else page_id
                revisit = response is not None and own != response and len(payload) >= min_bytes
                raw = gzip.compress(record(page_id, url, payload, digest, response, revisit), LEVEL, mtime=0)
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                index.append((f"{folder}/{name}", at, len(raw), url, digest, "revisit" if revisit else "response", page_id))
                at += len(raw)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names=["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        if out is not None:
            out.close()

    return _common.staged(plan.select("page_id", "url", "html", "_response").mapInArrow(save, INDEX), "warc-index")


def read(selected: DataFrame, gap: int = READ_GAP, most: int = READ_BYTES, payload: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload)."""
    n = _common.n_partitions(selected.sparkSession)
    # A large archive is dealt out by stretches of its bytes.
    stretch = F.floor(F.col("offset") / F.lit(8 * most))
    ordered = selected.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payload

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            opened, handle, at = None, None, 0
            while at < len(files):
                to, end = at + 1, offsets[at] + lengths[at]
                while to < len(files) and files[to] == files[at] and offsets[to] <= end + gap and offsets[to] + lengths[to] - offsets[at] <= most:
                    end = max(end, offsets[to] + lengths[to])
                    to += 1
                if opened != files[at]:
                    if handle:
                        handle.close()
                    fs, path = _common.filesystem(files[at])
                    opened, handle = files[at], fs.open_input_file(path)
                handle.seek(offsets[at])
                raw = handle.read(end - offsets[at])
                found = [parse(gzip.decompress(raw[o - offsets[at] : o - offsets[at] + n])) for o, n in zip(offsets[at:to], lengths[at:to])]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, kinds)], names=names)
                at = to
            if handle:
                handle.close()

    return ordered.mapInArrow(load, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index: one row per page."""
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), _common.scratch(spark, "warc"))
    back = read(index, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Five hexadecimal digits of the SHA-1 are four base-32 signs.
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(32), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1), 1)), '') AS payload_digest,
          max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM d
"""
