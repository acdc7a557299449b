"""Matroska columns: texts' bytes as 8-bit PCM packets, muxed into and parsed back from EBML.

The writer makes an EBML header and one segment: info, one audio track, clusters of simple blocks with fixed-size
lacing, and cues. The parser reads variable-length EBML elements (unknown sizes too), clusters, simple blocks and block
groups, all four kinds of lacing, and cues, into a packet table with track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, bound_batches, released

#: Element identifiers of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMECODE_SCALE, TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, BLOCK_GROUP, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_POSITIONS}

PACKET, RATE, LACED, CLUSTER_PACKETS = 576, 8000, 8, 256
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_clusters int"


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size of the least width that holds it, or of `width`."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(identifier: int, content: bytes) -> bytes:
    return identifier.to_bytes((identifier.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def number(identifier: int, n: int) -> bytes:
    return element(identifier, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def mux(payload: bytes, packet: int = PACKET, rate: int = RATE) -> bytes:
    """A file of one track of 8-bit mono PCM; payload is a positive multiple of packet long."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMECODE_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, size, at = [info, tracks], [], len(info) + len(tracks), 0
    step = packet * LACED
    for first in range(0, len(payload), packet * CLUSTER_PACKETS):
        start = first * 1000 // rate
        parts = [number(TIMECODE, start)]
        for at in range(first, min(first + packet * CLUSTER_PACKETS, len(payload)), step):
            data = payload[at : at + step]
            n = len(data) // packet
            time = struct.pack(">h", at * 1000 // rate - start)
            lace = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"  # keyframe, and fixed-size lacing
            parts.append(element(SIMPLE_BLOCK, b"\x81" + time + lace + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, size))))
        body.append(cluster)
        size += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file's elements say: per track its fields, all packets, and where cues point to (absolute)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int]] = field(default_factory=list)  # track, time in ns, start, size
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, cluster
    clusters: list[int] = field(default_factory=list)


def read_vint(raw: bytes, at: int, marker: bool = False) -> tuple[int, int]:
    """A variable-length number and where it ends; -1 for a size of ones only (unknown)."""
    width = 9 - raw[at].bit_length()
    if width > 8:
        raise ValueError("no EBML number here")
    n = int.from_bytes(raw[at : at + width], "big")
    if not marker:
        n -= 1 << 7 * width
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


def elements(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Identifier, own start, content start and content end of the elements between at and end."""
    while at < end:
        identifier, body = read_vint(raw, at, marker=True)
        size, body = read_vint(raw, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError("an element reaches beyond its parent")
        if size < 0 and identifier == CLUSTER:  # of unknown size: up to the next cluster or cues
            stop = body
            for child, own, _, stop_ in elements(raw, body, end):
                if child in (CLUSTER, CUES, INFO, TRACKS):
                    stop = own
                    break
                stop = stop_
        yield identifier, at, body, stop
        at = stop


def laces(raw: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """Start and size of the frames of a block whose flags are at `at`."""
    kind, at = raw[at] & 6, at + 1
    if not kind:
        return [(at, end - at)]
    n, at = raw[at] + 1, at + 1
    if kind == 4:
        if (end - at) % n:
            raise ValueError("frames of fixed size don't fill their block")
        return [(at + k * ((end - at) // n), (end - at) // n) for k in range(n)]
    sizes = []
    for k in range(n - 1):
        if kind == 2:  # Xiph: runs of 255
            size = 0
            while raw[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + raw[at])
            at += 1
        else:  # EBML: the first as it is, then signed differences
            width = 9 - raw[at].bit_length()
            v, at = read_vint(raw, at)
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0:
            raise ValueError("laced frames exceed their block")
        out.append((at, size))
        at += size
    return out


def uint(raw: bytes, a: int, b: int) -> int:
    return int.from_bytes(raw[a:b], "big")


def demux(raw: bytes) -> Media:
    media, found = Media(), False
    for top, _, body, end in elements(raw, 0, len(raw)):
        if top != SEGMENT:
            continue
        found = True
        for child, own, a, b in elements(raw, body, end):
            if child == INFO:
                media.scale = next((uint(raw, x, y) for i, _, x, y in elements(raw, a, b) if i == TIMECODE_SCALE), media.scale)
            elif child == TRACKS:
                for _, _, x, y in elements(raw, a, b):
                    entry = {i: (p, q) for i, _, p, q in elements(raw, x, y)}
                    if TRACK_NUMBER in entry:
                        audio = {i: raw[p:q] for i, _, p, q in elements(raw, *entry[AUDIO])} if AUDIO in entry else {}
                        media.tracks[uint(raw, *entry[TRACK_NUMBER])] = {"codec": raw[slice(*entry.get(CODEC_ID, (0, 0)))].decode(), "audio": audio}
            elif child == CLUSTER:
                media.clusters.append(own)
                clock = 0
                for i, _, x, y in elements(raw, a, b):
                    if i == TIMECODE:
                        clock = uint(raw, x, y)
                    elif i == SIMPLE_BLOCK:
                        block(media, raw, x, y, clock)
                    elif i == BLOCK_GROUP:
                        for j, _, p, q in elements(raw, x, y):
                            if j == BLOCK:
                                block(media, raw, p, q, clock)
            elif child == CUES:
                for _, _, x, y in elements(raw, a, b):
                    point = {i: (p, q) for i, _, p, q in elements(raw, x, y)}
                    where = {i: uint(raw, p, q) for i, _, p, q in elements(raw, *point[CUE_POSITIONS])}
                    media.cues.append((uint(raw, *point[CUE_TIME]) * media.scale, where[CUE_TRACK], body + where[CUE_CLUSTER]))
    if not found:
        raise ValueError("no segment")
    return media


def block(media: Media, raw: bytes, at: int, end: int, clock: int) -> None:
    track, at = read_vint(raw, at)
    time = (clock + struct.unpack(">h", raw[at : at + 2])[0]) * media.scale
    for start, size in laces(raw, at + 2, end):
        media.packets.append((track, time, start, size))


def feature(samples: np.ndarray, media: Media) -> str:
    """Integers only: packets, clusters, last time in ms, sum, sum of squares, crossings of the middle, and a histogram of packets by their mean."""
    s = samples.astype(np.int64)
    high = samples >= 128
    means = s.reshape(len(media.packets), -1).sum(axis=1) * 16 // (len(s) // len(media.packets)) // 256
    return f"{len(media.packets)}.{len(media.clusters)}.{media.packets[-1][1] // 1_000_000}.{int(s.sum())}.{int((s * s).sum())}.{int((high[1:] != high[:-1]).sum())}." + "-".join(map(str, np.bincount(means, minlength=16)[:16].tolist()))


def _columns(batches):
    for b in batches:
        data, offs = as_bytes(b.column("text"))
        raw = data.tobytes()
        out: list[list] = [[] for _ in range(9)]
        for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            text = raw[a:z]
            media_bytes = mux(text + b"\xff" * (-len(text) % PACKET if text else PACKET))
            media = demux(media_bytes)
            if any(cluster not in media.clusters for _, _, cluster in media.cues):
                raise ValueError("a cue points to no cluster")
            payload = b"".join(media_bytes[s : s + n] for _, _, s, n in media.packets)
            row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), feature(np.frombuffer(payload, np.uint8), media), len(media.packets), len(media.clusters))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document, see SCHEMA: its bytes are muxed, parsed back and digested, all within its task.

    A null or empty text is one packet of bytes 255. Equal texts have equal rows but for doc_id; repeated rows are
    repeated; a null doc_id stays null. Columns other than doc_id and text are not read.
    """
    bound_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(released(_columns), SCHEMA)
