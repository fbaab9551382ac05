"""WARC archives: one gzip member per record, written by tasks and read back by byte range."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lexgraph.session import ensure_importable, own_folder, write_table

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
_READ = 1 << 18
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI or plain path."""
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127) if c != 37))}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, payload, payload_digest, refers_to) to archives in ``folder``.

    Each task attempt writes a file of its own name and reports it; the returned
    table (path, bytes) lists only files of tasks that succeeded, so files left by
    a lost executor are never read.
    """
    ensure_importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        out, path, size = None, f"{root}/pages-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                member = record(page_id, url, payload or b"", digest, refers_to)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "bytes"])

    return pages.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "path string, bytes long")


class _Window:
    """A file's bytes from one place on, read in steps and dropped from the front."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(max(_READ, len(self.data)))  # twice as much each time: a long record is copied a few times only
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        self.data = self.data[to - self.base :]
        self.base = to


def member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(contents, end) of the gzip member that starts at ``at``, or None if none does.

    The header must be a gzip header without reserved flags and the contents must
    begin as a WARC record; the member's own checksum then confirms all of it.
    """
    start = at - window.base
    while len(window.data) - start < 10 and window.more():
        pass
    if window.data[start : start + 3] != MAGIC or len(window.data) - start < 10 or window.data[start + 3] & 0xE0:
        return None
    unpack, parts, used = zlib.decompressobj(31), [], start
    try:
        while not unpack.eof:
            if used == len(window.data) and not window.more():
                return None
            parts.append(unpack.decompress(window.data[used:]))
            used = len(window.data) - len(unpack.unused_data)
            head = parts[0] if len(parts[0]) >= 7 else b"".join(parts)
            if len(head) >= 7 and not head.startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    body = b"".join(parts)
    return (body, window.base + used) if body.startswith(b"WARC/1.") else None


def read_range(file, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end): scan for the magic, check, then follow on."""
    window, at = _Window(file, start), start
    while at < end:
        window.drop(at)
        found = member(window, at)
        if found:
            yield found[0]
            at = found[1]
            continue
        place = window.data.find(MAGIC, at + 1 - window.base)
        while place < 0:
            keep = window.base + max(len(window.data) - 2, 0)
            if keep >= end:
                return
            window.drop(keep)
            if not window.more():
                return
            place = window.data.find(MAGIC, max(at + 1 - window.base, 0))
        at = window.base + place


def parse(body: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of a record's contents."""
    head, _, block = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of page {page} differs")
    else:
        size, digest = int(http.decode().rpartition("Content-Length: ")[2]), fields["WARC-Payload-Digest"][len("sha256:") :]
        refers = int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return int(page) if page else None, size, digest, kind, refers, fields.get("WARC-Target-URI")


def read_archives(files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Read the archives listed in ``files`` (path, bytes): one task input for each byte range of ``split`` bytes."""
    ensure_importable(files.sparkSession)
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + split).alias("end"))
    spread = ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(folder)
        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(path) as file:
                    rows = [parse(x) for x in read_range(file, start, end)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    return spread.mapInArrow(run, SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Write one record per page, duplicates as revisits, and read all archives back.

    Among records with equal payloads of at least ``least`` bytes, that with the
    smallest page_id is a response and the others revisit it; rows that repeat
    this page_id are responses too, and rows without a page_id are always
    responses. A null html is an empty payload. Returns page_id, payload_bytes,
    payload_digest, record_type, refers_to and url, one row per page.
    """
    spark = pages.sparkSession
    folder = folder or own_folder(spark, "warc")
    if ":" not in folder:
        folder = f"file://{folder}"
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("key"), "first")
    key = F.when(F.octet_length("payload") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("p"), F.coalesce(F.col("page_id"), F.xxhash64("url"))))
    marked = rows.withColumn("key", key).join(first, "key", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))

    return read_archives(write_table(write_archives(marked, folder), "warc-files"), folder)
