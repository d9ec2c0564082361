"""WARC archives: a writer and a splittable reader.

Writer: one gzip member per record, one file per task, in a shared folder.
File names carry a fresh id per attempt and the manifest holds only what
committed tasks returned, so retried or speculative tasks leave no double
records.  Records with equal payloads of at least ``min_revisit`` bytes are
stored once, at the largest page_id; the others are revisit records without
the payload (identical-payload-digest profile, the full length in the HTTP
header).

Reader: every file is cut into byte ranges.  A task scans its range for the
gzip magic, takes a hit only if the member's start decodes to a WARC version
line and a complete record header, and owns the records that start inside
its range, reading past the range's end for the last one.

Defined cases: null html is an empty payload; null url an empty target; a
null page_id stays null and never is the target of a revisit unless all
equal payloads have none (then all are responses); repeated rows with the
largest page_id are all responses; no rows give no archive and no records;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, stored

# The gzip magic with method deflate, and the record version.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"

MANIFEST = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Adds ``refers_to``: the page whose equal payload the row repeats.  The
    per-digest maximum is combined map-side; only digests that occur twice
    go into the join, and html is shuffled only if those are many."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "_k", F.sha2("html", 256)
    )
    dup = (
        base.filter(F.octet_length("html") >= min_revisit)
        .groupBy("_k")
        .agg(F.max("page_id").alias("_ref"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _ref IS NOT NULL")
        .select("_k", "_ref")
    )
    dup = stored(dup, "warc-dup")
    ref = F.when(F.col("_ref") != F.coalesce("page_id", F.col("_ref") - 1), F.col("_ref"))
    return base.join(dup, "_k", "left").select("page_id", "url", "html", ref.alias("refers_to"))


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)


def _record(page_id, url: str, payload: bytes, ref) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n" + _headers(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    ) + b"\r\n"
    block = http if ref is not None else http + payload
    target, escaped = url or "", False
    if "\r" in target or "\n" in target or target != target.strip():  # would not survive as a header line
        target, escaped = quote(target, safe=""), True
    fields = [
        ("WARC-Type", "response" if ref is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if page_id is None or ref is not None else f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()),
    ]
    if escaped:
        fields.append(("X-Target-Quoted", "yes"))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if ref is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{ref}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + _headers(fields) + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, level: int = 4, min_revisit: int = 1000,
    roll_bytes: int = 1 << 30,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns the stored manifest
    (path, n_bytes, n_records).  A file is closed at ``roll_bytes``."""
    folder = folder or scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        out = path = None
        size = count = k = 0
        done: list[tuple[str, int, int]] = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, count))
                out = None

        for whole in batches:
            for b in slices(whole):
                for page_id, url, html, ref in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name = f"part-{TaskContext.get().partitionId():05d}-{k}-{uuid.uuid4().hex}.warc.gz"
                        path, size, count, k = f"{folder}/{name}", 0, 0, k + 1
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    m = _member(_record(page_id, url, html.encode(), ref), level)
                    out.write(m)
                    size, count = size + len(m), count + 1
                    if size >= roll_bytes:
                        close()
        close()
        for row in done:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, MANIFEST.types)], schema=MANIFEST)

    rows = revisits(pages, min_revisit).mapInArrow(write, "path string, n_bytes long, n_records long")
    return stored(rows, "warc-manifest")


class _Bytes:
    """Positioned reads from a file through a one-megabyte window."""

    def __init__(self, f, size: int, window: int = 1 << 20):
        self.f, self.size, self.window, self.at, self.buf = f, size, window, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if n <= 0:
            return b""
        if not (self.at <= pos and pos + n <= self.at + len(self.buf)):
            self.at, self.buf = pos, self.f.read_at(min(max(n, self.window), self.size - pos), pos)
        return self.buf[pos - self.at : pos - self.at + n]


def _find(src: _Bytes, pos: int, end: int) -> int:
    """First magic that starts in [pos, end), or -1."""
    while pos < end:
        chunk = src.get(pos, min(1 << 16, end - pos) + len(MAGIC) - 1)
        i = chunk.find(MAGIC)
        if i >= 0 and pos + i < end:
            return pos + i
        pos += 1 << 16
    return -1


def _read_member(src: _Bytes, pos: int) -> tuple[dict, bytes, int] | None:
    """(headers, block, position after the member), or None if no record
    starts here: the version line and header are decoded first."""
    z, out, at, head, total = zlib.decompressobj(31), [], pos, None, 0
    probe = b""
    try:
        while not z.eof:
            chunk = src.get(at, 1 << 10 if at == pos else 1 << 16)
            if not chunk:
                return None
            at += len(chunk)
            out.append(z.decompress(chunk))
            total += len(out[-1])
            if head is None:
                probe += out[-1]
                if not probe.startswith(VERSION[: min(len(probe), 7)]):
                    return None
                cut = probe.find(b"\r\n\r\n")
                if cut < 0:  # a header is read to its end, however long
                    continue
                lines = probe[:cut].decode("utf-8", "replace").split("\r\n")[1:]
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                if "warc-type" not in head or not head.get("content-length", "").isdigit():
                    return None
                start = cut + 4
    except zlib.error:
        return None
    if head is None:
        return None
    data = b"".join(out)
    block = data[start : start + int(head["content-length"])]
    if len(block) != int(head["content-length"]):
        return None
    return head, block, at - len(z.unused_data)


def _number(s: str | None) -> int | None:
    return int(s) if s and s.lstrip("-").isdigit() else None


def _row(head: dict, block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head["warc-type"]
    digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    if kind == "revisit":  # the payload is elsewhere: its figures stand in the headers
        digest = head.get("warc-payload-digest", "").rpartition(":")[2]
        lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n = int(lengths[0]) if lengths else 0
    url = head.get("warc-target-uri", "")
    if "x-target-quoted" in head:
        url = unquote(url)
    ref = head.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
    return (_number(head.get("x-page-id")), url, kind, _number(ref), n, digest, payload if with_payload else None)


def read_archives(
    spark: SparkSession, manifest: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = True
) -> DataFrame:
    """Records of the files in ``manifest`` (path, n_bytes), by byte ranges."""
    ranges = manifest.filter("n_bytes > 0").select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = _fs(path)
                with fs.open_input_file(at) as f:
                    src, rows, held = _Bytes(f, size), [], 0
                    pos, end = start, min(start + split_bytes, size)
                    while (pos := _find(src, pos, end)) >= 0:
                        found = _read_member(src, pos)
                        if found is None:
                            pos += 1
                            continue
                        head, block, pos = found
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append(_row(head, block, with_payload))
                        held += len(block) if with_payload else 64
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield _records(rows)
                            rows, held = [], 0
                    if rows:
                        yield _records(rows)

    # a task a range: the rows are tiny, so their number and not their size has to set the tasks
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0]
    return ranges.repartition(int(min(max(tasks or 1, 1), MAX_TASKS)), "path", "start").mapInArrow(
        read,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary",
    )


def read_whole(spark: SparkSession, manifest: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """The records of :func:`read_archives`, stored, after their number was
    held against the manifest's: archives that lost records fail the read."""
    got = stored(read_archives(spark, manifest, split_bytes, with_payload), "warc-records")
    n, want = got.count(), manifest.agg(F.sum("n_records")).first()[0] or 0
    if n != want:
        raise RuntimeError(f"the archives hold {n} readable records of {want} written")
    return got


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORDS.types)], schema=RECORDS)
