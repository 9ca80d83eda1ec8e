"""WARC records in seekable Zstandard bundles.

Records are written one after another into frames that decompress alone; a bundle ends with a skippable frame that
holds the seek table (compressed and uncompressed size of each frame, entry count, magic number), as the seekable
format of Zstandard lays down. An index maps each record id to its bundle, frame and offset within the frame, so
that one record costs one frame. Of equal payloads of at least ``least`` bytes only that of the largest page id is
stored; others are revisit records that refer to it.

Bundles go to the shared folder through Arrow's file systems (local paths, HDFS, S3 and such). A task names each
file anew and reports it only when it is complete; files of lost attempts are never referred to.

Rows: null html is an empty payload, a null url is written as a URN of the page id, control characters of urls are
escaped. Rows of the same page id and payload are all responses. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import blocks, scratch, stash

#: Fixed values of the seekable format: magic of its skippable frame, and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 128 << 20
#: Tasks that read bundles at most.
MOST_READERS = 20_000
INDEX = "page_id bigint, record_id string, bundle string, frame int, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to): what is stored, and what refers to it."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy(F.col("payload_digest").alias("key"))
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    # small payloads, which never meet a group, keep keys of their own and so are spread evenly
    key = F.when(F.octet_length("payload") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.lit(0)).cast("string")))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return (
        rows.withColumn("key", key)
        .join(groups, "key", "left")
        .select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: its header, and the HTTP response (without the payload, for a revisit)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if kind == "revisit" else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else _urn(page_id).strip("<>")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is None:
        head.append("X-No-URL: 1")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: memoryview) -> tuple:
    """The row of RECORD that one record stands for; its payload is checked against its digest."""
    whole = bytes(raw)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    said = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(said["Content-Length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(said["WARC-Payload-Digest"].partition(":")[2]).hex()
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind = said["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {said['WARC-Record-ID']} is damaged")
    url = None if "X-No-URL" in said else said["WARC-Target-URI"]
    return _page(said["WARC-Record-ID"]), url, kind, _page(said["WARC-Refers-To"]) if kind == "revisit" else None, digest, size, payload if kind == "response" else None


class Bundle:
    """One file being written."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, inner = fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        self.file = files.open_output_stream(f"{inner}/{self.path.rpartition('/')[2]}", compression=None)
        self.zstd, self.frames, self.rows, self.open, self.size, self.total = zstandard.ZstdCompressor(level=3, write_checksum=True), [], [], [], 0, 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.size and self.size + len(raw) > FRAME_BYTES:
            self.end_frame()
        self.rows.append((page_id, _urn(page_id), self.path, len(self.frames), self.size, len(raw)))
        self.open.append(raw)
        self.size += len(raw)

    def end_frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.total += len(packed)
            self.open, self.size = [], 0

    def close(self) -> list[tuple]:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()
        return self.rows


class Reader:
    """One bundle, read frame by frame through its seek table."""

    def __init__(self, path: str) -> None:
        files, inner = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(inner)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table that is understood")
        table = self.file.read_at(8 * n, end - 9 - 8 * n)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, size = self.sizes[k]
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size))
        return self.last[1]


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def write(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write bundles below ``folder``, one or more for each partition; the index, which is stored as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for i, j, _, _ in blocks(batch.column("payload").cast(pa.large_binary()).view(pa.large_string())):
                part = batch.slice(i, j - i)
                for page_id, url, payload, digest, kind, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                    bundle = bundle or Bundle(folder)
                    bundle.add(page_id, record(page_id, url, payload, digest, kind, refers_to, date))
                if bundle and bundle.total >= BUNDLE_BYTES:
                    yield _rows(INDEX, bundle.close())
                    bundle = None
        if bundle:
            yield _rows(INDEX, bundle.close())

    return stash(records.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                reader = Reader(path)
                for k in range(len(reader.sizes)):
                    frame, at, rows = memoryview(reader.frame(k)), 0, []
                    while at < len(frame):
                        head = bytes(frame[at : at + 4096])
                        cut = head.find(b"\r\n\r\n")
                        if cut < 0:  # a very long url
                            head = bytes(frame[at:])
                            cut = head.find(b"\r\n\r\n")
                        size = int(head[:cut].rpartition(b"Content-Length: ")[2])
                        end = at + cut + 4 + size + 4
                        rows.append(parse(frame[at:end]))
                        at = end
                    yield _rows(RECORD, rows)

    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, min(MOST_READERS, bundles.count()))).mapInArrow(run, RECORD)  # else one task may get all


@lru_cache(8)
def _reader(path: str) -> Reader:
    return Reader(path)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the page ids in ``ids`` (page_id), each through its own frame only."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id", "left_semi").select("bundle", "frame", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, frame, offset, length in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                raw = memoryview(_reader(bundle).frame(frame))
                yield _rows(RECORD, [parse(raw[offset : offset + length])])

    return wanted.mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write all pages, and give the index; ``folder`` is a new one in the shared place unless named."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return write(decide(pages, **columns), folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
