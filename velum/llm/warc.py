"""WARC archives: a writer with revisit records, and a splittable reader.

Written are WARC/1.1 files with one gzip member per record. Of pages with equal payloads the one with the smallest id is a
``response``, the others are ``revisit`` records that refer to it; which is which is settled by one aggregation over
payload digests, and its join lets adaptive execution split a payload that very many pages share. Each task writes files
of its own under names no other attempt uses, and returns their names and sizes; only files listed in that table are ever
read, so a lost or repeated task leaves no half archive behind.

The reader cuts each file into byte ranges. A task scans its range for the gzip magic, takes a place for a member if what
it inflates to begins with a WARC version line and complete headers, and owns each record that starts inside its range,
reading past the end of the range for the last one. A whole member gives the start of the next; after anything else the
scan goes on by one byte. Magic bytes inside compressed data are thereby passed over.

Files are opened by ``pyarrow.fs`` under the folder's own scheme; a plain path must be a mount that all executors share.

Defined cases: a null payload is empty; a null url is left out; control and non-ASCII characters of a url are
percent-encoded; rows that repeat a page_id with equal payloads are responses each, and with other payloads records of
their own; a page without id is the response only where none of its payload has one; an empty table gives no archive and
an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import match
from velum.sources.sinks import shared_path, written

MAGIC = b"\x1f\x8b\x08"
#: Files are closed beyond ``FILE_BYTES``; ranges are ``SPLIT_BYTES`` long; reads are ``CHUNK`` long.
FILE_BYTES, SPLIT_BYTES, CHUNK = 1 << 30, 8 << 20, 1 << 18
#: Ranges are read by as many tasks, up to this many.
MOST_TASKS = 100_000
DATE = "2000-01-01T00:00:00Z"
RECORD_SCHEMA = (
    "record_id string, record_type string, url string, page_id long, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary, damaged boolean, path string, offset long"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing -----------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, first_id, revisit)``: which pages repeat the payload of an earlier one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("digest")
    ).withColumn("bytes", F.length("payload").cast("long"))
    firsts = written(
        rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first_id")),
        "warc-firsts",
    )
    found = match(rows, firsts, ["digest", "bytes"])
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select("page_id", "url", "payload", "first_id", revisit.alias("revisit"))


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """One WARC record, before compression; ``first_id`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first_id is None else b"")
    head = {
        "WARC-Type": "response" if first_id is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "WARC-Refers-To": None if first_id is None else f"<urn:page:{first_id}>",
        "WARC-Profile": None
        if first_id is None
        else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_files(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        done, out = [], None
        try:
            for batch in batches:
                for page_id, url, payload, first_id, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(_member(record(page_id, url, payload, first_id if revisit else None)))
                    if out.tell() >= file_bytes:
                        done.append((name, out.tell()))
                        out.close()
                        out = None
            if out is not None:
                done.append((name, out.tell()))
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())],
            ["path", "bytes"],
        )

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages (page_id, url, html); the list of files, ``(path, bytes)``, is kept beside them."""
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    files = with_revisits(pages, min_bytes).mapInArrow(write_files(folder, file_bytes), "path string, bytes long")
    return written(files, "warc-files")


# ---- reading -----------------------------------------------------------------------------------------


def headers(lines: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


class Window:
    """A file read forward: ``data`` from ``pos`` on is what stands at ``start`` of the file; earlier bytes are let go."""

    def __init__(self, file, size: int, start: int, chunk: int = CHUNK):
        self.file, self.size, self.chunk = file, size, chunk
        self.base, self.data, self.pos = start, b"", 0

    @property
    def start(self) -> int:
        return self.base + self.pos

    def more(self) -> bool:
        """Reads on, the more the longer the piece at hand is; false at the end of the file."""
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        rest = self.data[self.pos :]
        self.base, self.pos = self.start, 0
        self.data = rest + self.file.read(min(max(self.chunk, len(rest)), self.size - at))
        return True

    def move(self, at: int) -> None:
        self.pos = at - self.base
        if self.pos > len(self.data):
            self.base, self.data, self.pos = at, b"", 0

    def find_magic(self, end: int) -> int | None:
        """Place of the next magic that starts before ``end``; the window moves there."""
        while self.start < end:
            at = self.data.find(MAGIC, self.pos)
            if at >= 0:
                self.pos = at
                return self.start if self.start < end else None
            self.pos = max(self.pos, len(self.data) - len(MAGIC) + 1)
            if not self.more():
                return None
        return None


def inflate(window: Window) -> tuple[bytes, int] | None:
    """The member at the window's place and its length; None if no WARC record begins there or the member is broken.

    A record's headers may have any length; a member without their end is no record.
    """
    z, out, used = zlib.decompressobj(31), [], 0
    size, begun, ended, tail = 0, False, False, b""
    while not z.eof:
        piece = window.data[window.pos + used : window.pos + used + window.chunk]
        if not piece:
            if not window.more():
                return None
            continue
        try:
            new = z.decompress(piece)
        except zlib.error:
            return None
        used += len(piece) - len(z.unused_data)
        out.append(new)
        size += len(new)
        if not begun and (size >= 6 or z.eof):
            if not b"".join(out).startswith(b"WARC/1"):
                return None
            begun = True
        if not ended:
            tail = tail[-3:] + new
            ended = b"\r\n\r\n" in tail
    return (b"".join(out), used) if begun and ended else None


def parse(data: bytes) -> dict | None:
    """A record's fields; None without the headers every record must have."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = headers(head)
    if not {"warc-type", "warc-record-id", "content-length"} <= h.keys() or not h["content-length"].isdigit():
        return None
    block = rest[: int(h["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        found = h.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found.lstrip("-").isdigit() else None

    stored = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "revisit":
        n = headers(http).get("content-length", "")
        digest, length, payload = stored, int(n) if n.isdigit() else None, None
    else:
        digest, length, payload = digest_of(body), len(body), body
    return {
        "record_id": h["warc-record-id"],
        "record_type": h["warc-type"],
        "url": h.get("warc-target-uri"),
        "page_id": page("warc-record-id"),
        "refers_to": page("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": payload,
        "damaged": payload is not None and stored not in ("", digest),
    }


def records_in(file, size: int, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, dict]]:
    """Place and fields of every record that starts in ``[start, end)``."""
    window = Window(file, size, start, chunk)
    while (at := window.find_magic(end)) is not None:
        member = inflate(window)
        fields = parse(member[0]) if member else None
        if fields is None:
            window.move(at + 1)
        else:
            yield at, fields
            window.move(at + member[1])


RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("damaged", pa.bool_()),
        ("path", pa.string()),
        ("offset", pa.int64()),
    ]
)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, start, end in zip(*[c.to_pylist() for c in batch.columns]):
            store, place = pyarrow.fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_file(place) as file:
                for offset, fields in records_in(file, size, start, end):
                    rows.append(fields | {"path": path, "offset": offset})
                    held += len(fields["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORD)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files ``(path, bytes)``; a range is the unit of work.

    ``damaged`` tells records whose payload does not have the digest stored with it; ``payload_digest`` is the payload's own.
    Ranges are tiny rows: without a number given adaptive execution would put them all into one task.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    ends = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0]
    return ends.repartition(max(1, min(int(n or 0), MOST_TASKS)), "path", "start").mapInArrow(_read_ranges, RECORD_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_warc(write_warc(pages, shared_path(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x{k} >> {shift}) & 31)::INT + 1, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)
_FIVES = ", ".join(f"('0x' || substr(h, {5 * k + 1}, 5))::INT AS x{k}" for k in range(8))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
x AS (SELECT page_id, html, {_FIVES} FROM p)
SELECT x.page_id, strlen(x.html)::BIGINT AS payload_bytes, concat({_BITS}) AS payload_digest,
  CASE WHEN f.first_id IS NULL OR x.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN x.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM x JOIN f USING (html)
"""
