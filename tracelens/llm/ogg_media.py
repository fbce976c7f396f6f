"""Media columns: texts stored as 8-bit samples in Ogg, and any Ogg bytes read back.

:func:`write_media` turns a binary column into Ogg files of two interleaved logical
streams: the samples, in packets of :data:`FRAME` bytes, and a description.
:func:`read_media` checks every page's checksum, puts packets together from lacing
values (over page borders too), separates logical streams by serial number and
derives a time for every packet from granule positions.

Defined results: null payloads are empty ones; an empty payload gives a file whose
sample stream has its header packet only; a damaged page is left out, the packet that
it cuts is dropped, and both are counted; bytes that are no Ogg at all give no streams.
Equal payloads give equal files, so repeated rows do too.
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

from .textkit import byte_view, chunks

#: Samples of a packet, samples a second, packets of a page at most.
FRAME, RATE, PAGE_PACKETS = 960, 8000, 40
#: The payload is padded to a positive multiple of this.
BLOCK = 192

# Fixed values of the container: capture pattern, header type flags.
PATTERN, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
SAMPLES_MAGIC, ABOUT_MAGIC = b"\x01pcm8\x00\x00\x00", b"\x01about\x00\x00"

_HEADER = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The container's CRC-32: polynomial 0x04C11DB7, most significant bit first, from 0.

    It is the mirror image of zlib's, so bytes and result are mirrored.
    """
    mirrored = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes

    def pack(self) -> bytes:
        head = _HEADER.pack(PATTERN, 0, self.flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + self.lacing
        crc = checksum(head + self.body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + self.body


def pages_of(serial: int, packets: list[tuple[bytes, int]], per_page: int = PAGE_PACKETS) -> list[Page]:
    """The pages of one logical stream, from packets and the granule position after each."""
    pages: list[Page] = []
    lacing, body, granule, held, flags = bytearray(), bytearray(), -1, 0, FIRST

    def flush(carry: bool) -> None:
        nonlocal lacing, body, granule, held, flags
        pages.append(Page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, held, flags = bytearray(), bytearray(), -1, 0, CONTINUED if carry else 0

    for k, (packet, after) in enumerate(packets):
        at = 0
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        while values:
            room = 255 - len(lacing)
            if not room:
                flush(at > 0)
                continue
            part, values = values[:room], values[room:]
            lacing += bytes(part)
            size = sum(part)
            body += packet[at:at + size]
            at += size
        granule, held = after, held + 1
        if held == per_page or k == 0:  # a header packet has a page of its own
            flush(False)
    if lacing or not pages:
        flush(False)
    pages[-1].flags |= LAST
    return pages


def mux(streams: list[list[Page]]) -> bytes:
    """The physical stream: all first pages, then the others in turn."""
    out = [s[0].pack() for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k].pack() for s in streams if k < len(s)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position after each packet that ends a page, -1 for the others.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    lost: int = 0
    _part: bytes | None = None
    _next: int = 0


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged places."""
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while True:
        found = data.find(PATTERN, at)
        if found < 0:
            bad += at < len(data)
            return streams, bad
        bad += found > at
        if found + 27 > len(data):
            return streams, bad + 1
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, found)
        lacing = data[found + 27:found + 27 + n]
        end = found + 27 + n + sum(lacing)
        page = data[found:end]
        if version or end > len(data) or len(lacing) < n or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, found + 1
            if (at := data.find(PATTERN, at)) < 0:
                return streams, bad
            continue
        at = end
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next or bool(flags & CONTINUED) != (s._part is not None):
            s.lost += s._part is not None or number != s._next
            s._part = None
        s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        skip = bool(flags & CONTINUED) and s._part is None  # its beginning is lost
        part, pos = s._part or b"", 27 + n
        before = len(s.packets)
        size = 0
        for v in lacing:
            size += v
            if v < 255:
                if skip:
                    skip = False
                else:
                    s.packets.append(part + page[pos:pos + size])
                    s.granules.append(-1)
                part, pos, size = b"", pos + size, 0
        s._part = None
        if lacing and lacing[-1] == 255 and not skip:
            s._part = part + page[pos:pos + size]
        if len(s.packets) > before and granule >= 0:
            s.granules[-1] = granule


def times(stream: Stream, durations: list[int], rate: int) -> list[float]:
    """Seconds at which each packet ends: from the next granule position known, less what follows the packet."""
    out: list[float] = [0.0] * len(stream.packets)
    known: int | None = None
    for k in range(len(stream.packets) - 1, -1, -1):
        if stream.granules[k] >= 0:
            known = stream.granules[k]
        out[k] = known / rate if known is not None else float("nan")
        if known is not None:
            known -= durations[k]
    return out


# ---------------------------------------------------------------- texts as media

def pad(payload: bytes) -> bytes:
    return payload + b" " * (max(1, -(-len(payload) // BLOCK)) * BLOCK - len(payload))


def to_ogg(payload: bytes, n_bytes: int) -> bytes:
    """``payload`` as samples, and a description with ``n_bytes``, its length before padding."""
    digest = hashlib.blake2b(payload, digest_size=4).digest()
    serial = int.from_bytes(digest, "little")
    packets = [(SAMPLES_MAGIC + struct.pack("<II", RATE, FRAME), 0)]
    packets += [(payload[i:i + FRAME], min(i + FRAME, len(payload))) for i in range(0, len(payload), FRAME)]
    about = [(ABOUT_MAGIC, 0), (struct.pack("<QI", n_bytes, zlib.crc32(payload)), len(payload))]
    return mux([pages_of(serial, packets), pages_of(serial ^ 0xFFFFFFFF, about)])


def from_ogg(media: bytes) -> tuple[bytes, int, dict]:
    """The samples, the length before padding and what the container shows."""
    streams, bad = demux(media)
    samples, n_bytes, shown = b"", 0, {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": 0, "end_s": 0.0, "bad": bad + sum(s.lost for s in streams.values())}
    for s in streams.values():
        if s.packets and s.packets[0].startswith(SAMPLES_MAGIC) and len(s.packets[0]) == 16:
            rate = struct.unpack("<II", s.packets[0][8:])[0]
            frames = s.packets[1:]
            ends = times(s, [0, *map(len, frames)], rate or 1)
            samples, shown["packets"], shown["end_s"] = b"".join(frames), len(frames), ends[-1]
        elif s.packets and s.packets[0] == ABOUT_MAGIC and len(s.packets) > 1:
            n_bytes = struct.unpack("<QI", s.packets[1])[0]
    return samples, n_bytes, shown


def feature_text(samples: bytes, shown: dict) -> str:
    """Container figures, and mean, energy and sign changes of the samples about 128, as integers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    change = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) else 0
    total, energy = int(x.sum()), int((x * x).sum())
    return f"streams={shown['streams']};pages={shown['pages']};packets={shown['packets']};end_ms={round(1000 * shown['end_s'])};bad={shown['bad']};sum={total};energy={energy};changes={change}"


def write_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, media (binary): every whole text's UTF-8 bytes, padded, as an Ogg file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(byte_view(batch.column(1))[1], 1 << 24):  # so many bytes at a time, not rows
                part = batch.slice(i, j - i)
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_ogg(pad(t), len(t)) for t in texts], pa.binary())], names=[key, "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, media binary")


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload (binary), media_bytes, media_sha256, feature of every file in column ``media``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(byte_view(batch.column(1))[1], 1 << 24):
                part = batch.slice(i, j - i)
                files = [x or b"" for x in part.column(1).to_pylist()]
                got = [from_ogg(x) for x in files]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()),
                    pa.array([len(x) for x in files], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                    pa.array([feature_text(g[0], g[2]) for g in got]),
                ], names=[key, "n_bytes", "payload", "media_bytes", "media_sha256", "feature"])

    return media.select(key, "media").mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string")
