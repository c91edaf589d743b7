"""Media columns in the Ogg container (RFC 3533): pages with checksums, packets in lacing values, several logical streams."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: The identification packet of a stream of 8-bit samples: a mark, the sample rate, the number of streams, this one's place.
IDENT = struct.Struct("<8sIBB")
MARK = b"\x7fPCMU8\0\0"
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def ogg_crc(data: bytes) -> int:
    """The container's CRC-32: polynomial 0x04c11db7, most significant bit first, from 0, nothing inverted. It is zlib's
    (least significant first) on bytes whose bits are reversed, with the same done to the result."""
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "big").translate(_REVERSED)[::-1], "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> Iterator[tuple[int, bytes]]:
    """(granule position at its end, page) of one logical stream. Each packet comes with the number of samples up to its
    end. The first packet has a page of its own; a page holds 255 lacing values at most; a packet that goes on into the
    next page leaves the page's granule position at -1 if no packet ends on it."""
    number, at = 0, 0
    yield 0, page(FIRST | (LAST if len(packets) == 1 else 0), packets[0][1], serial, 0, bytes([255] * (len(packets[0][0]) // 255) + [len(packets[0][0]) % 255]), packets[0][0])
    queue = [(p, g, 0) for p, g in packets[1:]]
    going = False
    while queue:
        lacing, body, granule, number, kind = bytearray(), [], -1, number + 1, CONTINUED if going else 0
        going = False
        while queue and len(lacing) < 255:
            packet, end, done = queue[0]
            values = (len(packet) - done) // 255 + 1
            if (room := 255 - len(lacing)) >= values:
                lacing += b"\xff" * (values - 1) + bytes([(len(packet) - done) % 255])
                body.append(packet[done:])
                granule = at = end
                queue.pop(0)
            else:
                lacing += b"\xff" * room
                body.append(packet[done : done + 255 * room])
                queue[0] = (packet, end, done + 255 * room)
                going = True
        yield at, page(kind | (0 if queue else LAST), granule, serial, number, bytes(lacing), b"".join(body))


def mux(payload: bytes, rate: int = 8000, streams: int = 2, block: int = 4096) -> bytes:
    """A physical stream with the payload as 8-bit samples: blocks are dealt to the logical streams in turn, one packet
    each; the granule position counts a stream's samples. Pages are interleaved in the order of their times, first pages
    foremost. Equal payloads give equal bytes."""
    series = []
    for k in range(streams):
        serial = 0x53540000 + k
        packets, samples = [(IDENT.pack(MARK, rate, streams, k), 0)], 0
        for i in range(k * block, len(payload), streams * block):
            packets.append((payload[i : i + block], samples := samples + len(payload[i : i + block])))
        series.append(list(pages_of(packets, serial)))
    firsts = [s[0][1] for s in series]
    rest = sorted(((at, k, i, p) for k, s in enumerate(series) for i, (at, p) in enumerate(s[1:])), key=lambda x: x[:3])
    return b"".join(firsts + [p for *_, p in rest])


@dataclass
class Stream:
    """A logical stream as read: packets, and (samples at its end or -1) for each."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    open: list[bytes] | None = None
    closed: bool = False


def demux(data: bytes) -> list[Stream]:
    """The logical streams in the order of their first pages. Raises ValueError for a wrong checksum, a lost or repeated
    page, a packet without its beginning or end, or a stream without an end."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) < at + HEAD.size:
            raise ValueError("a page's head is cut off")
        mark, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        start = at + HEAD.size + n
        lacing = data[at + HEAD.size : start]
        end = start + sum(lacing)
        if mark != b"OggS" or version or end > len(data):
            raise ValueError("not a page")
        if ogg_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page {number} of stream {serial}: wrong checksum")
        if bool(kind & FIRST) != (serial not in streams):
            raise ValueError(f"stream {serial}: begins twice or never")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or s.closed or bool(kind & CONTINUED) != (s.open is not None):
            raise ValueError(f"stream {serial}: page {number} is out of order")
        s.pages += 1
        done = []
        for value in lacing:
            s.open = [] if s.open is None else s.open
            s.open.append(bytes(view[start : start + value]))
            start += value
            if value < 255:
                done.append(b"".join(s.open))
                s.open = None
        s.packets += done
        s.ends += [-1] * (len(done) - 1) + [granule] * bool(done)
        if bool(done) != (granule >= 0):
            raise ValueError(f"stream {serial}: granule position of page {number}")
        s.closed = bool(kind & LAST)
        at = end
    if any(not s.closed or s.open is not None for s in streams.values()):
        raise ValueError("a stream has no end")
    return list(streams.values())


def unmux(data: bytes) -> tuple[bytes, list[dict]]:
    """The payload, and for each stream: serial, pages, packets, samples, and times (the seconds at which packets with a
    known granule position end)."""
    found = demux(data)
    parts: list[tuple[int, int, bytes]] = []
    about = []
    for s in found:
        mark, rate, streams, k = IDENT.unpack(s.packets[0])
        if mark != MARK or streams != len(found):
            raise ValueError("not a stream of samples")
        parts += [(i, k, p) for i, p in enumerate(s.packets[1:])]
        samples = sum(map(len, s.packets[1:]))
        if len(s.packets) > 1 and s.ends[-1] != samples:
            raise ValueError(f"stream {s.serial}: {samples} samples, granule position {s.ends[-1]}")
        about.append({"serial": s.serial, "pages": s.pages, "packets": len(s.packets) - 1, "samples": samples, "times": [e / rate for e in s.ends[1:] if e >= 0]})
    parts.sort(key=lambda x: x[:2])
    return b"".join(p for *_, p in parts), about


def padded(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and these bytes with zeros up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 8000, streams: int = 2, block: int = 4096) -> DataFrame:
    """(key, n_bytes, media binary) for every row. A null text counts as empty, and an empty one is stored as 64 zero bytes.
    A text of any length is stored whole; one is held at a time, beside the media of 256 rows at most. Equal texts have
    equal bytes; null keys and rows that repeat a key each have a row. Other columns are not carried, whatever their
    names. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # payloads of a few rows at a time
                part = b.slice(at, 256)
                got = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([mux(p, rate, streams, block) for _, p in got], pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", key)


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Reads the stored bytes back: (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature). feature names the streams, pages and packets, the time in milliseconds at which the last packet of each
    stream ends, and the samples' mean, mean square and sign changes about 128, in whole numbers. Null media: all null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(2):
                data = raw.as_py()
                if data is None:
                    rows.append((None,) * 6)
                    continue
                payload, about = unmux(data)
                x = np.frombuffer(payload, dtype=np.uint8)
                loud, total, square = x >= 128, int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.float64), x.astype(np.float64)))
                feature = f"streams={len(about)};pages={sum(s['pages'] for s in about)};packets={sum(s['packets'] for s in about)};ms={'/'.join(str(round(1000 * s['times'][-1])) if s['times'] else '0' for s in about)};mean={total // max(1, len(x))};square={square // max(1, len(x))};turns={int((loud[1:] != loud[:-1]).sum())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(key).alias("id"), F.col(n_bytes).alias("n_bytes"), F.col(media).alias("m")).mapInArrow(run, schema).withColumnRenamed("id", key)


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a media column of two logical streams, read back."""
    return media_features(encode_media(table(spark, sf_dir, "documents")))
