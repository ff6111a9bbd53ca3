"""WARC archives: a writer with a gzip member per record, and a splittable reader.

The reader's tasks own byte ranges, not files. A task scans its range for the gzip magic, validates each candidate by
decoding its header and the start of the record, and owns the records that start inside its range, reading past the end
of the range for the last one. Where a record ends the scan goes on, so bytes inside a record are not candidates.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, shared_dir, small_side

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task scans, and of one read.
RANGE, READ = 8 << 20, 1 << 18
#: Bytes from which on a task begins another archive, and tasks of a reader at most.
ARCHIVE, MOST_TASKS = 1 << 30, 200_000
#: What is decoded of a candidate before it counts as a record.
PROBE = b"WARC/1."

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One gzip member. A revisit has no payload; its headers carry the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_uri(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_uri(refers_to)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def revisits(pages: DataFrame, *, page_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(sha1, first): payloads of at least least_bytes that more than one row has, with the least page_id among them.

    Counts are pre-aggregated, so a payload that a third of the pages share is one row of each task.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(page_col).alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n"))
    return slim.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sha1", "first")


def write(pages: DataFrame, folder: str, *, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write a record per row under folder; returns the manifest (path, bytes), materialised.

    Every attempt of a task writes a file of its own and the manifest names the files of those that succeeded, so lost
    executors and second attempts leave nothing that is read. Null html is an empty payload. Rows that repeat the least
    page_id of a payload are all responses; if all ids of a payload are null, all rows are.
    """
    bound_batches(pages.sparkSession)
    firsts = cut(revisits(pages, page_col=page_col, html_col=html_col, least_bytes=least_bytes))
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.join(small_side(firsts), "sha1", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, size = None, "", 0
        for b in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                member = record(page_id, url, html, digest(html), first, first is not None and page_id != first)
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})

    return cut(rows.mapInArrow(run, "path string, bytes long"))


class _Window:
    """Reads of a file from a moving offset; what lies before the offset is let go."""

    def __init__(self, file, at: int):
        self.file, self.at, self.bytes = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.bytes += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.bytes[:n]
        self.at += n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """The record that starts at the window's offset and its compressed length, or None if no record starts there."""
    while len(window.bytes) < 10 and window.more():
        pass
    head = window.bytes[:10]
    if len(head) < 10 or head[:3] != MAGIC or head[3] & 0xE0:
        return None
    unpack, out, fed = zlib.decompressobj(31), [], 0
    seen = b""
    while not unpack.eof:
        if fed == len(window.bytes) and not window.more():
            return None
        try:
            part = unpack.decompress(window.bytes[fed:])
        except zlib.error:
            return None
        fed = len(window.bytes)
        out.append(part)
        if len(seen) < len(PROBE):
            seen += part[: len(PROBE)]
            if not PROBE.startswith(seen[: len(PROBE)]):
                return None
    raw, length = b"".join(out), fed - len(unpack.unused_data)
    while len(window.bytes) < length + len(MAGIC) and window.more():
        pass
    after = window.bytes[length : length + len(MAGIC)]
    return (raw, length) if _is_record(raw) and MAGIC.startswith(bytes(after)) else None


def _is_record(raw: bytes) -> bool:
    """Whether a decoded member is one record of the length that its header states."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    stated = re.search(rb"\r\ncontent-length:\s*(\d+)\s*(?:\r\n|$)", head, re.IGNORECASE)
    return bool(blank and stated) and len(rest) == int(stated[1]) + 4 and rest.endswith(b"\r\n\r\n")


def records(file, start: int, end: int) -> Iterator[bytes]:
    """The records (decoded) that start in [start, end) of a file."""
    window = _Window(file, start)
    while window.at < end:
        found = window.bytes.find(MAGIC)
        if found < 0:
            window.skip(max(0, len(window.bytes) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.skip(found)
        if window.at >= end:
            return
        member = _member(window)
        if member is None:
            window.skip(1)
            continue
        window.skip(member[1])
        yield member[0]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record: the entity of its HTTP response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def ranges(manifest: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, start, end) of byte ranges."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long")))
    return manifest.where("bytes > 0").select("path", "bytes", cuts.alias("start")).select("path", "start", F.least(F.col("start") + size, F.col("bytes")).alias("end"))


def read(manifest: DataFrame, folder: str, *, range_bytes: int = RANGE) -> DataFrame:
    """SCHEMA and payload (binary, null for revisits) of every record of the archives in the manifest."""
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    # Rows are small and stand for much work: a stated number of partitions is one that Spark leaves as it is.
    spread = ranges(manifest, range_bytes).repartition(min(int(n), MOST_TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for raw in records(file, start, end):
                        headers, payload = parse(raw)
                        if headers["warc-type"] == "revisit":
                            rows.append((_page(headers["warc-record-id"]), int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), "revisit", _page(headers["warc-refers-to"]), None))
                        else:
                            rows.append((_page(headers["warc-record-id"]), len(payload), digest(payload), "response", None, payload))
                        held += len(payload)
                        if held > READ * 16 or len(rows) >= 1000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spread.mapInArrow(run, f"{SCHEMA}, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one, as a URI."""
    at = shared_dir(spark)
    folder = f"{at if '://' in at or at.startswith('file:') else 'file://' + at}/warc-{uuid.uuid4().hex}"
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return folder


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archive pages and read them back: SCHEMA, one row per row of pages."""
    folder = archive_folder(pages.sparkSession)
    return read(write(pages, folder, **columns), folder).drop("payload")

