"""WARC archives, index first.

Each record is a gzip member of its own, as is usual for .warc.gz, so a record is read without those before it.

Writing: each task streams its pages into archive files in the shared folder and returns an index row per record (file,
offset, length, URL, digest), which is written as a table. Equal payloads are found by digest: the record of the largest
page_id is the response, the others revisit it and carry no payload. A retried task writes files of a new name; the
index names those of the attempt that succeeded, so others are never read.

Reading: the index is filtered first; what is selected is dealt out by file and block of BLOCK bytes, sorted by offset,
and neighbours are coalesced into one range read (gaps of GAP bytes are read over, READ bytes are read at once at most,
a longer record by itself).

Defined results: a null html is an empty payload; an empty payload is a payload like others; a null url gives a record
without a target; of repeated rows with the largest page_id of a payload, each is a response; a null page_id revisits
the largest of its payload, and is a response if there is none; a record's ID is of page_id and digest, so only rows that
are equal in both share one; a url with line breaks stands in a header of its own, in base64, and comes back as it was;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder, to_python

MIN_BYTES = 0
FILE_BYTES, LEVEL = 1 << 30, 6
BLOCK, GAP, READ, TASK = 4 << 20, 64 << 10, 4 << 20, 16 << 20
#: WARC asks for a date; a fixed one keeps reruns equal.
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string"
_FIELD = re.compile(rb"^([A-Za-z0-9-]+): (.*?)\r?$", re.M)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, sha1: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{sha1}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):\w+>", urn)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, compressed. A revisit's block is empty; its own field tells the full payload's length."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id, sha1)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
        if "\r" in url or "\n" in url:
            fields.append(("X-Target-URI-Base64", base64.b64encode(url.encode()).decode()))
    if revisit:
        fields.append(("WARC-Refers-To", _urn(refers_to, sha1)))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    block = b"" if revisit else payload
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.decode(): v.decode() for k, v in _FIELD.findall(head)}
    n = int(fields["Content-Length"])
    if not head.startswith(b"WARC/1.1") or rest[n:] != b"\r\n\r\n":
        raise ValueError("a byte range doesn't hold one whole record")
    return fields, rest[:n]


def _roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to), a row for each different pair: the page each payload refers to. No html is shuffled."""
    narrow = pages.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("n"))
    largest = narrow.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"))
    # As a table, so that the join is of two plain exchanges, and the many pages of one payload are split.
    return narrow.select("page_id", "sha1").distinct().join(materialize(largest, "warc-largest"), "sha1", "left")


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes archives into folder and returns the index, which is a table by then."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    roles = _roles(pages, min_bytes).withColumnRenamed("page_id", "role_id").withColumnRenamed("sha1", "role_sha1")
    same = F.col("page_id").eqNullSafe(F.col("role_id")) & (F.sha1("payload") == F.col("role_sha1"))
    rows = pages.join(roles, same).select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sha1 = digest(payload)
                    revisit = refers_to is not None and refers_to != page_id
                    data = record(page_id, url, payload, sha1, refers_to, revisit)
                    if out is None or at and at + len(data) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    index.append((page_id, name, at, len(data), url, sha1))
                    at += len(data)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[k] for r in index], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "file", "offset", "length", "url", "payload_digest"])
        finally:
            if out is not None:
                out.close()

    return materialize(to_python(rows).mapInArrow(run, _INDEX), "warc-index")


def _reads(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Coalesces (file, offset, length), sorted, into what is read at once."""
    held: list[tuple[str, int, int]] = []
    for r in rows:
        if held and (r[0] != held[0][0] or r[1] - (held[-1][1] + held[-1][2]) > GAP or r[1] + r[2] - held[0][1] > READ):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def read(selected: DataFrame, folder: str) -> DataFrame:
    """selected: index rows. The records behind them, parsed, with digests of full payloads recomputed and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for group in _reads(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if group[0][0] != name:
                    if source is not None:
                        source.close()
                    name, source = group[0][0], store.open_input_file(f"{path}/{group[0][0]}")
                out, start = [], group[0][1]
                source.seek(start)
                data = source.read(group[-1][1] + group[-1][2] - start)
                for _, offset, length in group:
                    fields, block = parse(data[offset - start : offset - start + length])
                    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and digest(block) != sha1:
                        raise ValueError(f"{name} at {offset}: the payload doesn't have its digest")
                    url = base64.b64decode(fields["X-Target-URI-Base64"]).decode() if "X-Target-URI-Base64" in fields else fields.get("WARC-Target-URI")
                    out.append((_page(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), sha1, kind, _page(fields.get("WARC-Refers-To", "")), url, block))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    block = F.floor(F.col("offset") / BLOCK)
    rows = selected.select("file", "offset", "length").withColumn("block", block)
    # Index rows are small beside what they point to, so the number of tasks follows the bytes that will be read.
    total = selected.agg(F.sum("length")).first()[0] or 0
    rows = rows.repartition(max(1, -(-total // TASK)), "file", "block").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archives all pages and reads every record back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)


#: DuckDB SQL for (page_id, payload_bytes, payload_digest, record_type, refers_to) over pages.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS largest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(x, ((i // 4) * 5 + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM g"""
