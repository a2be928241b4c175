from __future__ import annotations

import hashlib
import struct

import pyarrow.fs as fs
import zstandard
from pyspark.sql import functions as F

from quireflow.llm import tables, warc

SCHEMA = "page_id long, url string, html string, payload string, digest long"
BIG = "<p>" + "text é " * 60 + "</p>"


def pages(spark):
    rows = [(1, "http://a.example/1", BIG), (5, "http://a.example/5", BIG), (3, None, BIG), (9, "http://b.example/\r\nX-Page-ID: 4", "small"), (10, "u", "small"), (11, "u", None), (12, "u", ""), (None, "u", BIG), (13, "u", "x" * 3_000_000), (5, "http://a.example/5", BIG), (14, "u", "WARC/1.1\r\n\r\n" * 20)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    folder = tables.new_path(spark, "warc")
    manifest = warc.write_archives(pages(spark), folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(manifest, folder).collect()), key=str)
    want = []
    for p, html in [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]:
        again = p in (3, 5)
        want.append((p, len(html), hashlib.sha256(html).hexdigest(), "revisit" if again else "response", 1 if again else None, None if again else bytearray(html)))
    assert got == sorted(want, key=str)


def test_frames_stand_alone_and_manifest_finds_records(spark):
    folder = tables.new_path(spark, "warc")
    manifest = warc.write_archives(pages(spark), folder)
    files, root = fs.FileSystem.from_uri(folder)
    for r in manifest.collect():
        with files.open_input_file(f"{root}/{r.bundle}") as f:
            data = f.read()
        n = struct.unpack("<I", data[-9:-5])[0]
        assert data[-4:] == struct.pack("<I", warc.SEEKABLE_MAGIC) and n > r.frame
        # Ordinary readers skip the seek table.
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        frame = zstandard.ZstdDecompressor().decompress(data[r.frame_at : r.frame_at + r.frame_size])
        head, _, end = warc.parse(frame, r.record_at)
        assert end == r.record_at + r.record_size and head["warc-record-id"] == f"<{r.record_id}>"
    one = warc.fetch(spark, manifest, folder, spark.range(13, 14).withColumnRenamed("id", "page_id")).collect()
    assert len(one) == 1 and bytes(one[0].record).count(b"x" * 3_000_000) == 1


def test_empty_table(spark):
    folder = tables.new_path(spark, "warc")
    manifest = warc.write_archives(pages(spark).where(F.lit(False)), folder)
    assert warc.read_archives(manifest, folder).count() == 0
