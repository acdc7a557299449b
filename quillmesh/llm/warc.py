"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is its frames, a skippable frame that maps record identifiers to
frame-relative offsets, and a skippable frame with the seek table in Zstandard's seekable format. Any record can be read
by its identifier with one frame decompressed. Bundles are bounded in size and are rows of a table that Spark writes, so
they can live in any store and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, materialize, released

#: Fixed values of the Zstandard frame formats: skippable frames' magic numbers, and that of a seek table's end.
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEAST_REVISIT = 256 << 10, 8 << 20, 100
URN = "urn:page:"
BUNDLES = "bundle_id long, n_records int, bundle binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """The fields and the block of the record that begins at `at`."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, raw[end + 4 : end + 4 + int(fields["Content-Length"])]


class BundleWriter:
    """Collects records into frames of about FRAME_BYTES before compression."""

    def __init__(self, level: int = 3):
        import zstandard

        self.codec = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, identifier: str, raw: bytes) -> None:
        if self.filled and self.filled + len(raw) > FRAME_BYTES:
            self.close()
        self.index.append((identifier, len(self.frames), self.filled))
        self.open.append(raw)
        self.filled += len(raw)

    def close(self) -> None:
        if self.open:
            frame = self.codec.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.size += len(frame)
            self.open, self.filled = [], 0

    def bundle(self) -> bytes:
        self.close()
        index = json.dumps(self.index, separators=(",", ":")).encode()
        table = b"".join(struct.pack("<II", c, d) for c, d in [*self.sizes, (len(index) + 8, 0)])
        foot = table + struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE_END)
        return b"".join(self.frames) + struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_MAGIC, len(foot)) + foot


class BundleReader:
    """Random access to a bundle's records; the last frame read is kept."""

    def __init__(self, bundle: bytes):
        import zstandard

        n, flags, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEKABLE_END or flags & 0x80:
            raise ValueError("no seek table without checksums at the end")
        entries = struct.iter_unpack("<II", bundle[-9 - 8 * n : -9])
        self.spans, at = [], 0
        for c, d in entries:
            self.spans.append((at, c, d))
            at += c
        start, size, _ = self.spans.pop()
        if struct.unpack("<II", bundle[start : start + 8]) != (INDEX_MAGIC, size - 8):
            raise ValueError("no record index before the seek table")
        self.index = json.loads(bundle[start + 8 : start + size])
        self.places = {name: (f, at) for name, f, at in reversed(self.index)}  # of records of one name, the first
        self.bundle, self.codec, self.kept = bundle, zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            at, c, d = self.spans[k]
            self.kept = k, self.codec.decompress(self.bundle[at : at + c], max_output_size=d)
        return self.kept[1]

    def find(self, identifier: str) -> tuple[dict[str, str], bytes] | None:
        if identifier not in self.places:
            return None
        f, at = self.places[identifier]
        return parse(self.frame(f), at)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for _, f, at in self.index:
            yield parse(self.frame(f), at)


def _write(batches):
    writer, count = BundleWriter(), 0
    first = TaskContext.get().partitionId() << 33

    def done(w: BundleWriter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([first + count], pa.int64()), pa.array([len(w.index)], pa.int32()), pa.array([w.bundle()], pa.binary())], names=["bundle_id", "n_records", "bundle"])

    for b in batches:
        for page, url, html, digest, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            page, refers = page.as_py(), refers.as_py()
            raw = bytes(html.as_buffer()) if html.is_valid else b""
            writer.add(f"{URN}{'' if page is None else page}", record(page, url.as_py(), raw, digest.as_py(), refers))
            if writer.size >= BUNDLE_BYTES:
                yield done(writer)
                writer, count = BundleWriter(), count + 1
    if writer.index:
        yield done(writer)


def _read(batches):
    for b in batches:
        for bundle in b.column("bundle"):
            out: list[list] = [[], [], [], [], []]
            for fields, block in BundleReader(bundle.as_py()):
                kind, name = fields["WARC-Type"], fields["WARC-Record-ID"][1:-1].removeprefix(URN)
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != stated):
                    raise ValueError(f"the payload of {name} isn't what was written")
                refers = fields.get("WARC-Refers-To")
                for column, value in zip(out, (int(name) if name else None, size, stated, kind, int(refers[1:-1].removeprefix(URN)) if refers else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The written bundles (bundle_id, n_records, bundle) of every page, one record each.

    Of the pages with equal payloads of at least `least` bytes, those with the smallest page_id are responses (a repeated
    row of it is a response again), others revisit it. A null html is an empty payload; rows with a null page_id take
    part, but never are what others refer to; where all have none, all are responses. Only page_id, url and html are
    read. An empty table gives no bundles.

    Payloads aren't dealt anew: what is joined to them is one row per payload that occurs more than once, which Spark
    broadcasts while it is small and else sorts both sides by.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_ = rows.filter(F.octet_length("html") >= least)
    again = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1 and first is not null").select("digest", "first")
    again = materialize(again, "warc-again")
    marked = rows.join(again, "digest", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    written = materialize(marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(released(_write), BUNDLES), "warc")
    forget(again)
    return written


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record of bundles; see RECORDS. A payload that isn't what was written fails."""
    bound_batches(bundles.sparkSession, rows=4)
    return bundles.select("bundle").mapInArrow(released(_read), RECORDS)
