"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of WARC records, followed by a seek table: a skippable frame with the
compressed and decompressed size of every frame, its frame count and the format's magic number, as in Zstandard's seekable format.
Writing gives a manifest that maps a record's id to its bundle, frame and offset inside the frame, so that one record is read by
decompressing one frame. The name of a bundle holds the attempt of the task that wrote it and the manifest
names only bundles of attempts that Spark committed, so tasks may fail, run again or run twice.

Payloads stay where they are read: only digests and ids are shuffled to find equal payloads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Bytes of records in a frame, and of frames in a bundle, before the next is begun.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Revisits, some 60 bytes each, that may be broadcast to the pages.
BROADCAST_REVISITS = 500_000
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "page_id long, record_type string, record_id string, bundle string, frame int, frame_at long, frame_size long, record_at long, record_size long"


def one_line(value: str) -> str:
    """A header value without line breaks: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(kind: str, record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has no block, its payload's digest and size stand in the header."""
    block = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers with names in lower case, block, end) of the record at a place."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(head["content-length"])
    return head, data[end + 4 : end + 4 + size], end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of an open bundle."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, whole in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, whole))
        at += packed
    return out


class Bundler:
    """Groups records into frames and frames into bundles of one task; finished records come out as manifest rows."""

    def __init__(self, folder: str, task: int, attempt: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.task, self.attempt, self.number = task, attempt, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.out, self.frames, self.at, self.group, self.grown = None, [], 0, [], 0
        self.rows: list[tuple] = []

    @property
    def name(self) -> str:
        return f"bundle-{self.task:06d}-{self.attempt}-{self.number:04d}.warc.zst"

    def add(self, page_id, kind: str, record_id: str, data: bytes) -> None:
        self.group.append((page_id, kind, record_id, self.grown, data))
        self.grown += len(data)
        if self.grown >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.group:
            return
        if self.out is None:
            self.files.create_dir(self.root, recursive=True)
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
        frame = self.packer.compress(b"".join(x[4] for x in self.group))
        self.out.write(frame)
        self.rows += [(p, k, r, self.name, len(self.frames), self.at, len(frame), at, len(data)) for p, k, r, at, data in self.group]
        self.frames.append((len(frame), self.grown))
        self.at, self.group, self.grown = self.at + len(frame), [], 0
        if self.at >= BUNDLE_BYTES:
            self.end_bundle()

    def end_bundle(self) -> None:
        self.end_frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
        self.out, self.frames, self.at, self.number = None, [], 0, self.number + 1


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row into bundles under folder, a URI that all executors share, and returns the manifest as a written table.

    Of equal payloads of LEAST_REVISIT bytes or more, the rows with the smallest id are responses and others revisit it. Null payloads
    count as empty. Rows with a null id are responses of their own and nothing refers to them. Repeated rows each get a record; those that share the smallest id are all
    responses. Null urls are left out of the record. A record's id is
    made of the page's and its place in the task, so no two share it; a revisit names the page that it refers to. date is that of every record. An empty table writes no bundle.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.where("page_id is not null").select("page_id", F.length("payload").alias("size"), F.unhex(F.sha2("payload", 256)).alias("digest")).where(F.col("size") >= LEAST_REVISIT)
    firsts = keyed.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("digest", "refers_to")
    revisits = tables.written(keyed.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    revisits = tables.small_or_not(revisits, BROADCAST_REVISITS).withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    marked = rows.join(revisits, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")
    folder = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId()
        out = Bundler(folder, task, f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        serial = 0

        def told() -> pa.RecordBatch:
            names = [f.split()[0] for f in MANIFEST.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            columns = list(zip(*out.rows, strict=True)) or [[]] * len(names)
            out.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (c[i].as_py() for c in batch.columns)
                kind = "response" if refers is None else "revisit"
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{digest.hex()}/{task}/{serial}").urn
                serial += 1
                out.add(page, kind, record_id, record(kind, record_id, page, url, payload, digest.hex(), refers, date))
            yield told()
        out.end_bundle()
        yield told()

    return tables.written(marked.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record, read back frame by frame.

    The frames come from the bundles' own seek tables. Digest and size of a response are taken of the payload as read, and a digest that differs from the header's
    is an error; those of a revisit, whose payload is null, stand in its header.
    """
    folder = folder.rstrip("/")
    bundles = manifest.select("bundle").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                path = f"{root}/{name}"
                with files.open_input_file(path) as f:
                    for at, packed, whole in read_seek_table(f, f.size()):
                        f.seek(at)
                        data = unpacker.decompress(f.read(packed), max_output_size=whole)
                        rows, place = [], 0
                        while place < len(data):
                            head, block, place = parse(data, place)
                            told = head["warc-payload-digest"].removeprefix("sha256:")
                            revisit = head["warc-type"] == "revisit"
                            if not revisit and hashlib.sha256(block).hexdigest() != told:
                                raise ValueError(f"{path}: digest differs in {head['warc-record-id']}")
                            page = head.get("x-page-id")
                            rows.append((page and int(page), int(head["x-payload-length"]) if revisit else len(block), told, head["warc-type"], int(head["x-refers-to-page"]) if revisit else None, head.get("warc-target-uri"), None if revisit else block))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    spread = bundles.repartition(max(1, bundles.sparkSession.sparkContext.defaultParallelism * 4), "bundle")
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def fetch(spark: SparkSession, manifest: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """(page_id, record) of the wanted pages alone: each by seeking to its frame and taking its bytes at the offset in the frame."""
    folder = folder.rstrip("/")
    wanted = manifest.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with files.open_input_file(f"{root}/{r['bundle']}") as f:
                    f.seek(r["frame_at"])
                    data = zstandard.ZstdDecompressor().decompress(f.read(r["frame_size"]))
                out.append(data[r["record_at"] : r["record_at"] + r["record_size"]])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], names=["page_id", "record"])

    return wanted.select("page_id", "bundle", "frame_at", "frame_size", "record_at", "record_size").mapInArrow(one, "page_id long, record binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tables.new_path(spark, "warc")
    manifest = write_archives(tables.read(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts""",
}
