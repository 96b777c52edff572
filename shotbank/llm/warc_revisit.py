"""WARC archives in which repeated payloads become revisit records.

Archives are written by Spark's text writer (one file per task, committed by its protocol, so a lost
executor leaves no half archive) and read whole, file by file, by Content-Length. Headers alone are
shuffled by payload digest to find each payload's original response. The writer compresses an archive as one gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.llm.common import written
from shotbank.session import scratch_path

#: Payload bytes in one archive file, about; a reader holds one file at a time.
FILE_BYTES = 32 << 20
CRLF = "\r\n"
RECORD_ID = re.compile(rb"<urn:page:(-?\d*)>")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_sha1, payload_bytes) of every page; a null html is an empty payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return _pages(pages).select("*", F.sha1(payload).alias("payload_sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(d, refers_to): each SHA-1 of at least ``min_bytes`` that several records have, and the largest
    page_id among them. A record of that page_id is the response, the others revisit it; a null page_id
    ranks below all others.

    One aggregation over headers (max per digest, combined before the shuffle, so a payload that a
    third of all pages share costs one row per task).
    """
    return (heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_sha1")
            .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
            .where("n > 1").select(F.col("payload_sha1").alias("d"), "refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Write one record per page under ``path``: a response with its payload, or a revisit that
    names the original and has no block.

    Pages are the rows: a repeated page_id gives repeated records (all of the largest page_id of a
    payload are responses). A null page_id ranks below all others and is written as an empty id.
    Control characters of a url are percent-encoded; a null url is written empty. Columns other than
    page_id, url and html are ignored. A task begins a new archive, in ``path/part=<n>``, whenever the one before holds
    ``file_bytes``, so it has one record more than that at most. ``date`` (now, unless given) is when the records were made.
    """
    heads = headers(pages)
    # written before it is joined with its rows, so that Spark can split a hot payload
    found = written(resolve(heads, min_bytes), "revisited")
    # by the row's own payload: a page_id may be null or stand at several payloads
    rows = heads.join(found, F.col("payload_sha1") == F.col("d"), "left")
    again = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = rows.select("page_id", "url", "html", "refers_to", again.alias("again")).mapInArrow(
        _archives(file_bytes, date), "value string, part int")
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").partitionBy("part").text(path)


def _archives(file_bytes: int, date: str):
    """Records in the order of the rows, and the number of each one's archive in its task."""

    def run(batches):
        part = held = 0
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(("page_id", "url", "html", "refers_to", "again"))}
            values, parts = _record(columns, date), []
            for v in values:
                if held >= file_bytes:
                    part, held = part + 1, 0
                held += len(v)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(parts, pa.int32())], names=["value", "part"])

    return run


def _record(cols: dict, date: str) -> list[str]:
    out = []
    for page, url, html, refers, again in zip(*(cols[c].to_pylist() for c in (
            "page_id", "url", "html", "refers_to", "again"))):
        payload = (html or "").encode("utf-8")
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
        lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}",
                 f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}",
                 f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
        if again:
            lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
            payload = b""
        else:
            lines += ["Content-Type: text/html; charset=utf-8"]
        lines += [f"Content-Length: {len(payload)}", "", ""]
        out.append(CRLF.join(lines) + payload.decode("utf-8"))
    return out


def parse(data: bytes):
    """Yield (header dict, payload) of an unpacked archive."""
    pos = 0
    while pos < len(data):
        end = data.index(b"\r\n\r\n", pos)
        lines = data[pos:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {pos}")
        head = dict(x.split(b": ", 1) for x in lines[1:])
        size = int(head[b"Content-Length"])
        yield head, data[end + 4:end + 4 + size]
        pos = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_digest, payload_bytes, refers_to, url) of every record under
    ``path``. Digest and length are those of the full payload: a response's are computed from the
    bytes read (a digest unlike the header's raises), a revisit's come from the response it names.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
             .select("path", "content"))

    def run(batches):
        for batch in batches:
            for data in batch.column(1):
                rows = {k: [] for k in ("page_id", "record_type", "payload_digest", "payload_bytes",
                                        "refers_to", "url")}
                for head, payload in parse(zlib.decompress(data.as_py(), 31)):
                    kind = head[b"WARC-Type"].decode()
                    digest = head[b"WARC-Payload-Digest"].split(b":")[1].decode()
                    if kind == "response" and digest != digest_of(payload):
                        raise ValueError(f"payload digest of {head[b'WARC-Record-ID']!r} does not match")
                    num = [RECORD_ID.match(head.get(k, b"<urn:page:>"))[1] for k in (b"WARC-Record-ID", b"WARC-Refers-To")]
                    rows["page_id"].append(int(num[0]) if num[0] else None)
                    rows["refers_to"].append(int(num[1]) if num[1] else None)
                    rows["record_type"].append(kind)
                    rows["payload_digest"].append(digest)
                    rows["payload_bytes"].append(len(payload) if kind == "response" else None)
                    rows["url"].append(head[b"WARC-Target-URI"].decode())
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in (
                    "page_id", "payload_bytes", "refers_to") else pa.string()) for k, v in rows.items()})

    recs = files.mapInArrow(run, "page_id long, record_type string, payload_digest string, "
                                 "payload_bytes long, refers_to long, url string")
    # a revisit has no block: its original, named by page and digest, knows the length
    origin = (recs.where("record_type = 'response'")
              .groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("full")))
    return (recs.join(origin, F.col("payload_digest") == F.col("d"), "left")
            .select("page_id", "record_type", "payload_digest",
                    F.coalesce("payload_bytes", "full").alias("payload_bytes"), "refers_to", "url"))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to the shared scratch folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
