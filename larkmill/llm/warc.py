"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table in a skippable frame (compressed and plain size
of every frame), as the public seekable format lays down. An index maps each record identifier to bundle, frame, offset in
the plain frame and length, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, table

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Plain bytes that a reading task is given, about, and frames of a bundle that are read together.
READ_BYTES, FRAMES_TOGETHER = 32 << 20, 16
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def record_bytes(page_id: int, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One WARC record. A revisit names the response and the full payload's digest and size, and holds no payload."""
    full = len(payload)
    if kind == "revisit":
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % full
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {full}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, payload and end of the record that starts at a place."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[stop + 4 : stop + 4 + size]
    return head, block[block.index(b"\r\n\r\n") + 4 :], stop + 4 + size + 4


def _id(urn: str | None) -> int | None:
    text = urn.strip("<>").rpartition(":")[2] if urn else "None"
    return None if text == "None" else int(text)


class BundleWriter:
    """Writes one bundle; add() returns the place of a record, finish() appends the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.held_bytes, len(record))
        self.held.append(record)
        self.held_bytes += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.press.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.held_bytes))
            self.written += len(packed)
            self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Random access to the frames of one bundle through its seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpress = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        entries = list(struct.iter_unpack("<II", source.read(8 * count)))
        self.frames, at = [], 0
        for packed, plain in entries:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return self.unpress.decompress(self.source.read(packed), max_output_size=max(plain, 1))

    def record(self, frame: int, offset: int, length: int) -> tuple[dict, bytes]:
        return parse_record(self.frame(frame)[offset : offset + length])[:2]


def opened(uri: str, write: bool = False):
    """A file by URI, in any store that pyarrow reaches."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def with_types(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, url, payload, digest, first: first is the smallest key among equal payloads of at least LEAST_REVISIT bytes.

    Smaller payloads are not looked up: they are dealt out one by one, so that the many empty ones do not meet in a task.
    """
    base = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("look", F.when(large, F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string")))
    firsts = base.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("look"), "first")
    return base.join(firsts, "look", "left").select("page_id", "url", "payload", "digest", "first")


def write_bundles(typed: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles into a shared folder, returns the index (a table in that folder).

    Each attempt of a task writes bundles of new names; the index names only those of attempts that ended well. Records of a
    null key are always responses.
    """

    def run(batches):
        import pyarrow as pa

        sink = writer = name = None
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    rows = []
                    for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                        if writer is None:
                            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                            sink = opened(name, write=True)
                            writer = BundleWriter(sink, frame_bytes)
                        kind = "revisit" if None not in (first, page_id) and first != page_id else "response"
                        place = writer.add(record_bytes(page_id, url, kind, first, digest, payload))
                        rows.append((page_id, name, *place))
                        if writer.written + writer.held_bytes > bundle_bytes:
                            writer.finish()
                            sink.close()
                            sink = writer = None
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
            if writer is not None:
                writer.finish()
        finally:
            if sink is not None:
                sink.close()

    spark = typed.sparkSession
    lean(typed).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index names, each taken at its place; digests of responses are taken anew from what was read.

    Runs of FRAMES_TOGETHER frames of a bundle are the unit of work: a task opens few bundles, and decompresses a frame once for all
    of its records. The number of tasks follows the bytes to read.
    """

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        source = bundle = at = None
        try:
            for batch in batches:
                rows, held = [], 0
                for name, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at is None or at[0] != name:
                        if source is not None:
                            source.close()
                        source = opened(name)
                        bundle, at = BundleReader(source), None
                    if at != (name, frame):
                        data, at = bundle.frame(frame), (name, frame)
                    head, payload, end = parse_record(data, offset)
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    kind = head["WARC-Type"]
                    if end != offset + length or kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{name}: {head['WARC-Record-ID']} is damaged")
                    rows.append((_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, _id(head.get("WARC-Refers-To")), size, digest, payload if payloads and kind == "response" else None))
                    held += length
                    if held > FRAME_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            if source is not None:
                source.close()

    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(size / READ_BYTES))
    placed = index.repartition(tasks, "bundle", F.floor(F.col("frame") / FRAMES_TOGETHER)).sortWithinPartitions("bundle", "frame", "offset")
    return lean(placed).select("bundle", "frame", "offset", "length").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, records): writes every row of pages as a WARC record and reads the bundles back.

    Null html is an empty payload, null urls give no target. Rows with one key and equal payloads are all responses if the key
    is the smallest; rows of a null key are all responses, and no other row revisits them. An empty table gives no bundle. Other
    columns are not read.
    """
    index = write_bundles(with_types(pages), folder or fresh(pages.sparkSession, "warc"))
    return index, read_bundles(index)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back."""
    return read_bundles(write_bundles(with_types(table(spark, sf_dir, "pages")), fresh(spark, "warc")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """DuckDB."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM q"""
