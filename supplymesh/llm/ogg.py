"""Ogg as a column format: pages with checksums, lacing, multiplexed logical streams, granule positions.

Writing: a payload of bytes is taken as 8-bit samples and dealt packet by packet to the logical
streams in turn. Each stream begins with an identification packet on a page of its own (first page
of the stream) and ends with a page marked last; packets may span pages. The granule position of a
page is the number of samples of its stream in the packets that end on it or before, and -1 (all
bits set) if none ends there.

Reading: pages are found by their capture pattern, their checksums verified, their packets put
together from the lacing values, the streams told apart by serial number and checked for gaps in
their page sequence, and times derived from granule positions and the sample rate.
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
from pyspark.sql import functions as F

from supplymesh.llm.common import lean, prepare, schema_with, spare

#: Fixed by the format: capture pattern, header layout, flags, the granule position of a page on which no packet ends.
CAPTURE, HEADER, NO_GRANULE = b"OggS", struct.Struct("<4sBBqIIIB"), -1
CONTINUED, FIRST, LAST = 1, 2, 4
#: This module's identification packet: magic, version, stream, streams, sample rate, samples of all streams, bytes in a packet.
IDENT, MAGIC = struct.Struct("<8sBBBIQI"), b"u8audio\x00"
RATE, STREAMS, PACKET, SEGMENTS = 8000, 2, 6000, 64

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC: polynomial 0x04c11db7, most significant bit first, no inversion.

    zlib's has the same polynomial with bits mirrored and inverted ends: so it is taken of mirrored
    bytes from a zero state, and its bits mirrored.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def _pages(serial: int, ident: bytes, packets: list[bytes], segments: int) -> Iterator[bytes]:
    """The pages of one stream. A packet of n bytes has n // 255 lacing values of 255 and one of n % 255."""
    yield page(serial, 0, 0, FIRST | (LAST if not packets else 0), bytes([len(ident)]), ident)
    lacing, body, sequence, samples, granule, continued = bytearray(), [], 1, 0, NO_GRANULE, 0
    for number, packet in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = segments - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += now
            body.append(packet[at : at + size])
            at += size
            if not values:
                samples += len(packet)
                granule = samples
            last = number == len(packets) - 1 and not values
            if len(lacing) == segments or last:
                yield page(serial, sequence, granule, continued | (LAST if last else 0), bytes(lacing), b"".join(body))
                sequence += 1
                lacing, body, granule = bytearray(), [], NO_GRANULE
                continued = CONTINUED if values else 0


def write(samples: bytes, rate: int = RATE, streams: int = STREAMS, packet: int = PACKET, segments: int = SEGMENTS) -> bytes:
    """One physical stream that holds the samples in multiplexed logical streams. Equal samples make equal bytes."""
    if not 1 <= streams <= 255 or not 1 <= segments <= 255 or packet < 1:
        raise ValueError("streams and segments are 1 to 255, packet is positive")
    cut = [samples[i : i + packet] for i in range(0, len(samples), packet)]
    own = [iter(_pages(0x5D00 + s, IDENT.pack(MAGIC, 1, s, streams, rate, len(samples), packet), cut[s::streams], segments)) for s in range(streams)]
    out = [next(p) for p in own]  # all first pages come before all others
    while own:
        for p in list(own):
            if (x := next(p, None)) is None:
                own.remove(p)
            else:
                out.append(x)
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets complete so far) of each page on which a packet ends.
    granules: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] = field(default_factory=list)
    next_page: int = 0


class Damaged(ValueError):
    """A stored stream that isn't what was written."""


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number. Wrong checksums, gaps, cut pages and packets are errors."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE:
            raise Damaged(f"no page at byte {at}")
        if at + 27 > len(data):
            raise Damaged("a page header is cut")
        _, version, flags, granule, serial, sequence, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        begin, end = at + 27 + count, at + 27 + count + sum(lacing)
        if version or end > len(data) or len(lacing) < count:
            raise Damaged(f"the page at byte {at} is cut or of another version")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise Damaged(f"the page at byte {at} has a wrong checksum")
        if flags & FIRST:
            if serial in streams:
                raise Damaged(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or sequence != s.next_page or bool(flags & CONTINUED) != bool(s.partial):
            raise Damaged(f"the page at byte {at} doesn't follow in stream {serial}")
        s.next_page, s.pages, done = sequence + 1, s.pages + 1, len(s.packets)
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                s.packets.append(b"".join([*s.partial, data[begin : begin + run]]))
                s.partial, begin, run = [], begin + run, 0
        if lacing and lacing[-1] == 255:
            s.partial.append(data[begin : begin + run])
        if (granule == NO_GRANULE) != (len(s.packets) == done):
            raise Damaged(f"the page at byte {at} has a granule position that doesn't fit its packets")
        if granule != NO_GRANULE:
            s.granules.append((granule, len(s.packets)))
        s.ended = bool(flags & LAST)
        at = end
    if bad := [s.serial for s in streams.values() if not s.ended or s.partial]:
        raise Damaged(f"stream {bad[0]} isn't complete")
    return streams


@dataclass
class Audio:
    samples: bytes
    rate: int
    streams: int
    pages: int
    #: Seconds at which each stream's packets end, by its pages' granule positions, the streams one after the other.
    times: list[float]


def read(data: bytes) -> Audio:
    """What ``write`` stored, with every check that the format allows."""
    found = demultiplex(data)
    parts: dict[int, list[bytes]] = {}
    times: list[float] = []
    rate = total = count = 0
    for s in found.values():
        if not s.packets or len(s.packets[0]) != IDENT.size:
            raise Damaged(f"stream {s.serial} has no identification")
        magic, version, own, count, rate, total, _ = IDENT.unpack(s.packets[0])
        if magic != MAGIC or version != 1:
            raise Damaged(f"stream {s.serial} is of another kind")
        parts[own] = s.packets[1:]
        ends = np.cumsum([len(p) for p in parts[own]], dtype="i8")
        for granule, done in s.granules:
            if granule != (ends[done - 2] if done > 1 else 0):
                raise Damaged(f"stream {s.serial}: a granule position disagrees with its samples")
            if done > 1:
                times.append(granule / rate)
    if sorted(parts) != list(range(count)):
        raise Damaged("a stream is missing")
    dealt = [b""] * sum(map(len, parts.values()))
    for own, packets in parts.items():
        dealt[own::count] = packets
    samples = b"".join(dealt)
    if len(samples) != total:
        raise Damaged("samples are missing")
    return Audio(samples, rate, count, sum(s.pages for s in found.values()), times)


def feature(audio: Audio) -> str:
    """Streams, pages, seconds, the last derived time, and level, spread, sign changes and bands of the samples, unsigned 8-bit around 128."""
    x = np.frombuffer(audio.samples, "u1").astype("i4") - 128
    bands = np.bincount(np.frombuffer(audio.samples, "u1") >> 5, minlength=8)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    level = float(np.sqrt(np.mean(x.astype("f8") ** 2))) if len(x) else 0.0
    return (
        f"streams={audio.streams};pages={audio.pages};seconds={len(x) / audio.rate:.6f};last={max(audio.times, default=0.0):.6f}"
        f";mean={float(x.mean()) if len(x) else 0.0:.4f};rms={level:.4f};changes={changes};bands={','.join(map(str, bands))}"
    )


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text with bytes 0 up to a positive multiple of 64; its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def store_column(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """df with its text column stored as Ogg: binary ``media``, and the unpadded length in bytes.

    Null counts as the empty text, stored as 64 zero bytes. Other columns pass through, except ones with a new
    column's name, which give way. Row by row, no shuffle.
    """
    prepare(df.sparkSession)
    source = spare(df, "__text")
    kept = df.withColumn(source, F.col(f"`{text}`").cast("string")).drop(media, n_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            payloads = [padded(t) for t in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array([write(p) for p, _ in payloads], pa.binary()), pa.array([n for _, n in payloads], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != at] + [media, n_bytes])

    return kept.mapInArrow(lean(run), schema_with(kept.drop(source), (media, "binary"), (n_bytes, "long")))


#: What reading a stored column adds: its payload, and the features of its samples.
READ = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_column(df: DataFrame, media: str = "media", with_payload: bool = True) -> DataFrame:
    """df with what its stored media hold (see READ; ``payload`` only if asked for). Damaged media are errors; null media give nulls."""
    prepare(df.sparkSession)
    added = [tuple(x.split()) for x in READ.split(", ") if with_payload or not x.startswith("payload binary")]
    kept = df.drop(*(n for n, _ in added))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(added)
        audio = read(data)
        p = audio.samples
        found = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(audio))
        return (p, *found) if with_payload else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(added)
            kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, added))], names=[*batch.schema.names, *(n for n, _ in added)])

    return kept.mapInArrow(lean(run), schema_with(kept, *added))
