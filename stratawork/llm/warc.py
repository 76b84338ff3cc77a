"""WARC records in seekable Zstandard bundles.

A bundle is a WARC file of independent Zstandard frames, each holding whole records
of about ``frame_bytes``; a skippable frame at its end is the seek table of the
seekable format: compressed and decompressed size per frame. A record is found by
its frame and its offset in the frame, so one record costs one frame to read. The
index of all records is a table.

Bundles are written by the tasks that hold the pages, under names of their own. The
index, written last, names the bundles that count: what a lost or repeated task
left behind is in no index and is never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, column

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = ("page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, "
         "offset bigint, length bigint")
RECORD = ("page_id bigint, record_type string, refers_to bigint, url string, "
          "digest string, payload binary")
READERS = 10_000
LENGTH = b"\r\nContent-Length: "
#: The date of all records: bundles of the same pages are the same bytes.
DATE = "1970-01-01T00:00:00Z"


def record(page: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload. Line ends in a url are escaped."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    uri = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is None:
        head.remove(f"WARC-Target-URI: {uri}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes | memoryview) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = bytes(raw)
    split = raw.index(b"\r\n\r\n")
    lines = raw[:split].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = split + 4
    return head, raw[start:start + int(head["Content-Length"])]


def page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


class Bundle:
    """Writes one bundle to a stream."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.limit = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.written = 0
        self.places: list[tuple] = []
        self._waiting: list[tuple] = []

    def add(self, page: int | None, raw: bytes) -> None:
        if self.open and self.held + len(raw) > self.limit:
            self.close_frame()
        self._waiting.append((page, len(self.frames), self.held, len(raw)))
        self.open.append(raw)
        self.held += len(raw)

    def close_frame(self) -> None:
        if not self.open:
            return
        packed = self.pack.compress(b"".join(self.open))
        self.out.write(packed)
        self.places += [(p, f, self.written, len(packed), o, n) for p, f, o, n in self._waiting]
        self.frames.append((len(packed), self.held))
        self.written += len(packed)
        self.open, self._waiting, self.held = [], [], 0

    def finish(self) -> None:
        """Close the last frame and append the seek table."""
        self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(stream, size: int) -> list[tuple[int, int, int, int]]:
    """Of a bundle: start, compressed size, decompressed start and size per frame."""
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if flags & 0x80 else 8
    stream.seek(size - 9 - n * entry)
    raw = stream.read(n * entry)
    out, at, plain = [], 0, 0
    for i in range(n):
        packed, unpacked = struct.unpack_from("<II", raw, i * entry)
        out.append((at, packed, plain, unpacked))
        at, plain = at + packed, plain + unpacked
    return out


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as executors see it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def records_of(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a bundle, frame by frame."""
    system, name = opened(path)
    unpack = zstandard.ZstdDecompressor()
    with system.open_input_file(name) as stream:
        for start, packed, _, plain in seek_table(stream, stream.size()):
            stream.seek(start)
            raw, at = unpack.decompress(stream.read(packed), max_output_size=max(1, plain)), 0
            while at < len(raw):
                split = raw.index(b"\r\n\r\n", at)
                # At the start of a line only: a url may hold this text, but no line end.
                length = raw.index(LENGTH, at, split + 2) + len(LENGTH)
                end = split + 4 + int(raw[length:raw.index(b"\r\n", length)]) + 4
                yield parsed(raw[at:end])
                at = end


def fetch(path: str, frame_start: int, frame_bytes: int, offset: int,
          length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    system, name = opened(path)
    with system.open_input_file(name) as stream:
        stream.seek(frame_start)
        raw = stream.read(frame_bytes)
    return parsed(zstandard.ZstdDecompressor().decompressobj().decompress(raw)[offset:offset + length])


def with_types(pages: DataFrame, key: str = "page_id", html: str = "html",
               least_bytes: int = 100) -> DataFrame:
    """``pages`` with ``payload`` (UTF-8, null: empty), ``payload_digest`` and
    ``refers_to``: of payloads of at least ``least_bytes`` bytes that are equal, the
    row with the smallest key keeps null, the others name it. Rows without key have
    no place in that order: their payload stands for itself."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.withColumn("payload", payload).withColumn("payload_digest", F.sha2(payload, 256))
    long = rows.where((F.octet_length("payload") >= least_bytes) & F.col(key).isNotNull())
    # Of all payloads only digests and keys are compared; few have a copy.
    first = long.groupBy("payload_digest").agg(
        F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    copies = long.select(key, "payload_digest").join(first, "payload_digest").where(
        F.col(key) != F.col("__first")).select(key, "payload_digest", F.col("__first").alias("refers_to")).distinct()
    return rows.drop("refers_to").join(copies, [key, "payload_digest"], "left")


def write(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html",
          bundle_bytes: int = 64 << 20, frame_bytes: int = 256 << 10, level: int = 3) -> DataFrame:
    """Write one record per row into bundles under ``root`` and give the index:
    per record its bundle, frame, the frame's start and size, the record's offset
    and length in the frame. The index is lazy: write it out before use.

    Rows with the same key are records of their own; a null key, url or html is
    allowed. A record longer than a frame has a frame for itself. An empty table
    writes no bundle."""
    typed = with_types(pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                                    F.col(html).alias("html")), "page_id", "html").select(
        "page_id", "url", "payload", "payload_digest", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(root)
        system.create_dir(folder, recursive=True)
        bundle, name, stream = None, "", None

        def index() -> pa.RecordBatch:
            bundle.finish()
            stream.close()
            p = list(zip(*bundle.places))
            n = len(bundle.places)
            return pa.RecordBatch.from_arrays(
                [pa.array(p[0], pa.int64()), pa.array([f"{root}/{name}"] * n), pa.array(p[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in p[2:]]],
                names=["page_id", "bundle", "frame", "frame_start", "frame_bytes", "offset", "length"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for page, u, body, digest, to in zip(*(column(part, c).to_pylist() for c in (
                        "page_id", "url", "payload", "payload_digest", "refers_to"))):
                    if bundle is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        stream = system.open_output_stream(f"{folder}/{name}", compression=None)
                        bundle = Bundle(stream, frame_bytes, level)
                    bundle.add(page, record(page, u, body, digest, to))
                    if bundle.written >= bundle_bytes:
                        yield index()
                        bundle = None
        if bundle is not None:
            yield index()

    return typed.mapInArrow(run, INDEX)


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The records of all bundles of an index with the digests their headers give,
    a revisit with null payload.
    Bundles are dealt out over the tasks, each read once from end to end."""
    bundles = index.select("bundle").distinct()
    # A row is small, the bundle it names is not: a task for each.
    bundles = bundles.repartition(min(READERS, max(1, bundles.count())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in column(batch, "bundle").to_pylist():
                rows, held = [], 0
                for head, payload in records_of(path):
                    to = page_of(head.get("WARC-Refers-To"))
                    uri = head.get("WARC-Target-URI")
                    if uri is not None:
                        uri = uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((page_of(head["WARC-Record-ID"]), head["WARC-Type"], to, uri,
                                 head["WARC-Payload-Digest"].removeprefix("sha256:"),
                                 payload if head["WARC-Type"] == "response" else None))
                    held += len(payload)
                    if held > 8 << 20:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    return bundles.mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(c, kinds)],
        names=["page_id", "record_type", "refers_to", "url", "digest", "payload"])


def digests(work: Workspace, records: DataFrame) -> DataFrame:
    """Per record: page, size and digest of its full payload, type, what it refers
    to. A response's come from its payload; a revisit's are those of the response
    that it names, looked up by page and digest."""
    own = work.table(records.select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"), "record_type", "refers_to"))
    asked = own.where("record_type = 'revisit'").drop("payload_bytes")
    held = own.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    again = asked.join(held, ["refers_to", "payload_digest"]).select(*own.columns)
    return own.where("record_type = 'response'").union(again)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages to bundles in the shared folder, read them back, and give
    the digests of what was read."""
    work = Workspace(pages.sparkSession)
    index = work.table(write(pages, f"{work.path}/bundles", key, url, html))
    return digests(work, read(pages.sparkSession, index)).withColumnRenamed("page_id", key)


#: What ``round_trip`` must give, in DuckDB's SQL.
ORACLE = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha256(raw) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first < page_id AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id AND payload_bytes >= 100 THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
