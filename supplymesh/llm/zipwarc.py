"""Web archives packaged as ZIP: WARC records in stored members, read by ranges without extraction.

An archive has three members, all stored: ``archive/data.warc.gz``, a gzip member for each record;
``indexes/index.cdxj``, a line for each record with its offset and length there; and
``datapackage.json``. The reader finds the central directory through the end record, or through the
ZIP64 locator and end record where a field overflows, resolves each member's ZIP64 extra field and
local header, and then asks only for the ranges it needs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import checkpointed, lean, prepare, stored

#: Fixed by the ZIP format: signatures and layouts of the local header, central entry, end record, ZIP64 end record and locator.
LOCAL, ENTRY, END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
END64, LOCATOR = struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
SIGNATURES = {"local": b"PK\3\4", "entry": b"PK\1\2", "end": b"PK\5\6", "end64": b"PK\6\6", "locator": b"PK\6\7"}
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of records after which an archive is closed; one record always fits.
ARCHIVE_BYTES = 4 << 20
#: Payloads of fewer bytes are never stored as revisits.
REVISIT_LEAST = 100
#: A payload is hot with more than this part of all copies.
HOT = 1000


class Damaged(ValueError):
    """An archive that isn't what was written."""


# --- ZIP -----------------------------------------------------------------------------------------


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """Members stored without compression. ``zip64``: use the ZIP64 structures even where sizes would fit without."""
    out, central = [], []
    at = 0
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= FULL32 or at >= FULL32
        extra = struct.pack("<2H2Q", EXTRA64, 16, size, size) if wide else b""
        shown = FULL32 if wide else size
        version = 45 if wide else 20
        head = LOCAL.pack(SIGNATURES["local"], version, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<2H3Q", EXTRA64, 24, size, size, at) if wide else b""
        central.append(ENTRY.pack(SIGNATURES["entry"], version, version, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra)
        out += [head, data]
        at += len(head) + size
    directory = b"".join(central)
    n, size, wide = len(members), len(directory), zip64 or len(members) >= FULL16 or at >= FULL32
    out.append(directory)
    if wide:
        out.append(END64.pack(SIGNATURES["end64"], 44, 45, 45, 0, 0, n, n, size, at))
        out.append(LOCATOR.pack(SIGNATURES["locator"], 0, at + size, 1))
    out.append(END.pack(SIGNATURES["end"], 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else size, FULL32 if wide else at, 0))
    return b"".join(out)


#: read(offset, length) -> bytes of a file.
ReadRange = Callable[[int, int], bytes]


@dataclass
class Member:
    name: str
    method: int
    crc: int
    stored: int
    size: int
    header: int


class ZipDirectory:
    """The members of a ZIP file of ``size`` bytes, through range reads."""

    def __init__(self, read: ReadRange, size: int):
        self.read = read
        tail_at = max(0, size - END.size - FULL16)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(SIGNATURES["end"])
        while at >= 0 and (at + END.size > len(tail) or at + END.size + END.unpack_from(tail, at)[7] != len(tail)):
            at = tail.rfind(SIGNATURES["end"], 0, at)
        if at < 0:
            raise Damaged("no end of central directory")
        _, _, _, _, count, length, offset, _ = END.unpack_from(tail, at)
        if FULL16 == count or FULL32 in (length, offset):
            where = tail_at + at - LOCATOR.size
            found = read(where, LOCATOR.size) if where >= 0 else b""
            if found[:4] != SIGNATURES["locator"]:
                raise Damaged("no ZIP64 locator")
            end = read(LOCATOR.unpack(found)[2], END64.size)
            if end[:4] != SIGNATURES["end64"]:
                raise Damaged("no ZIP64 end of central directory")
            count, length, offset = END64.unpack(end)[7:]
        self.members: dict[str, Member] = {}
        directory, at = read(offset, length), 0
        for _ in range(count):
            if directory[at : at + 4] != SIGNATURES["entry"]:
                raise Damaged("the central directory is cut")
            _, _, _, _, method, _, _, crc, packed, plain, n, m, k, _, _, _, header = ENTRY.unpack_from(directory, at)
            name = directory[at + ENTRY.size : at + ENTRY.size + n].decode()
            extra = directory[at + ENTRY.size + n : at + ENTRY.size + n + m]
            plain, packed, header = self._wide(extra, [plain, packed, header])
            self.members[name] = Member(name, method, crc, packed, plain, header)
            at += ENTRY.size + n + m + k

    @staticmethod
    def _wide(extra: bytes, values: list[int]) -> list[int]:
        """The values, with those that overflow taken from the ZIP64 extra field, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, at)
            if kind == EXTRA64:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                return [wide.pop(0) if v == FULL32 and wide else v for v in values]
            at += 4 + n
        return values

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members.get(name)
        if m is None:
            raise Damaged(f"no member {name}")
        if m.method or m.stored != m.size:
            raise Damaged(f"{name} isn't stored, so its ranges can't be read")
        head = self.read(m.header, LOCAL.size)
        if head[:4] != SIGNATURES["local"]:
            raise Damaged(f"{name} has no local header")
        return m.header + LOCAL.size + sum(LOCAL.unpack(head)[9:11])

    def range(self, name: str, offset: int, length: int) -> bytes:
        m, at = self.members[name], self.start(name)
        if offset < 0 or offset + length > m.size:
            raise Damaged(f"a range outside {name}")
        return self.read(at + offset, length)

    def whole(self, name: str) -> bytes:
        at = self.start(name)
        data = self.read(at, self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc:
            raise Damaged(f"{name} has a wrong checksum")
        return data


# --- WARC ----------------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    digits = re.fullmatch(r"<urn:x-page:(-?\d*)>", record)
    if not digits:
        raise Damaged(f"a record of another kind: {record[:60]}")
    return int(digits[1]) if digits[1] else None


def _line(value: str) -> str:
    """A header's value: control characters and line ends percent-encoded, so that a url can't end its line."""
    return re.sub(r"[\x00-\x20\x7f\x85]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one record: a response with its payload, or a revisit that names the record which has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    page_id: int | None
    kind: str
    refers_to: int | None
    digest: str
    payload_bytes: int
    #: The payload; None for revisits.
    payload: bytes | None


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    return first, {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if x)}


def read_record(member: bytes) -> Record:
    """The record in a gzip member; its lengths and a response's digest are verified."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, fields = _headers(head)
    n = int(fields["content-length"])
    if version != "WARC/1.1" or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("a record is cut or of another version")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size, digest = int(_headers(http)[1]["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if len(payload) != size or found != digest:
            raise Damaged("a payload differs from its digest or length")
        return Record(page_of(fields["warc-record-id"]), kind, None, found, len(payload), payload)
    return Record(page_of(fields["warc-record-id"]), kind, page_of(fields["warc-refers-to"]), digest, size, None)


def write_archive(records: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """An archive of (url, gzip member) records."""
    at, lines = 0, []
    for url, member in records:
        lines.append(f"{_line(url)} 20240101000000 {json.dumps({'offset': at, 'length': len(member)})}")
        at += len(member)
    data, index = b"".join(m for _, m in records), "\n".join(sorted(lines)).encode("utf-8", "surrogatepass")
    resources = [{"path": p, "hash": f"sha256:{hashlib.sha256(x).hexdigest()}", "bytes": len(x)} for p, x in ((DATA, data), (INDEX, index))]
    return write_zip([(DATA, data), (INDEX, index), (PACKAGE, json.dumps({"profile": "data-package", "resources": resources}).encode())], zip64)


def read_archive(read: ReadRange, size: int) -> Iterator[Record]:
    """Each record of an archive, by its index and range reads."""
    found = ZipDirectory(read, size)
    lines = found.whole(INDEX).decode("utf-8", "surrogatepass")
    start, limit = found.start(DATA), found.members[DATA].size
    for line in lines.split("\n") if lines else []:
        where = json.loads(line.split(" ", 2)[2])
        if where["offset"] < 0 or where["offset"] + where["length"] > limit:
            raise Damaged("the index points outside its member")
        yield read_record(read(start + where["offset"], where["length"]))


# --- over tables ---------------------------------------------------------------------------------


def originals(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """``pages`` (page_id, url, payload binary) with digest (binary SHA-256), first, and revisit: whether another page has the payload.

    ``first`` is the least page_id with the same payload, for payloads of at least ``least`` bytes that several
    page_ids have. Payloads with over a thousandth of all copies, which can't be more than a thousand, get it by broadcast. For the others, digests
    and ids are matched without payloads; the payloads then meet their decisions by page id and digest, which no group of copies makes uneven.
    """
    keyed = pages.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    light = keyed.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    several = checkpointed(light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"))
    total = several.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(several.filter(F.col("n") > total / HOT).select(F.col("digest").alias("d"), F.col("first").alias("f")))  # at most HOT rows
    cold = several.filter(F.col("n") <= total / HOT).select("digest", "first")
    later = light.join(cold, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    known = keyed.join(hot, F.col("digest") == F.col("d"), "left").drop("d")
    at_once = known.filter("f is not null").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("f")), F.col("f")))
    apart = known.filter("f is null").join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")
    return apart.unionByName(at_once).select("page_id", "url", "payload", "digest", "first", F.col("first").isNotNull().alias("revisit"))


def archives(pages: DataFrame, least: int = REVISIT_LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (name string, content binary) of a page table (page_id, url, html).

    A record for each row, null html an empty payload. Of pages with equal payloads of at least ``least`` bytes the one with the
    least page_id is a response and the others revisit it; rows that repeat a page_id and payload are alike, and so have the same
    kind; null page_ids count as larger than any, and are responses where no page_id is known. Extra columns are ignored.
    """
    prepare(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}.wacz"]), pa.array([write_archive(held)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((url or "", write_record(page_id, url, payload, digest.hex(), first, revisit)))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    return originals(base, least).mapInArrow(lean(run), "name string, content binary")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def records(found: DataFrame, content: str = "content", with_payload: bool = False) -> DataFrame:
    """A row for each record of stored archives (binary ``content``; null: none), with its payload if asked for (null for revisits)."""
    prepare(found.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                data = value.as_buffer()
                read = memoryview(data)
                rows = [(r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload)[: 5 + with_payload] for r in read_archive(lambda at, n: bytes(read[at : at + n]), len(data))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return found.select(F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(lean(run), RECORDS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """A page table written as archives to the shared folder and read back: RECORDS."""
    return records(stored(archives(pages), "archives"))
