"""WARC records in ZIP archives, and a reader that takes records by range.

An archive is a ZIP whose members are stored, not deflated:

    archive/0000.warc.gz   records, each a gzip member of its own
    indexes/0000.cdxj      a line per record: key, date and JSON with filename, offset, length

Since members are stored, a record's place in the archive is its member's place
plus its offset, and one range read gets it. ``directory`` finds the members: it
parses the end record, the ZIP64 locator and end record where a field overflows,
and the central directory; nothing is extracted. A WARC member that no index
names is walked record by record. Of equal payloads of at least ``LEAST`` bytes
the row with the largest page_id is a response, the others are revisits of it.

Every writing attempt has file names of its own and the list of archives names
those of the attempts that Spark took, so a retried task leaves no half archive
in it. An archive is closed at ``ARCHIVE`` bytes, a member at ``MEMBER`` bytes or
``RECORDS`` records, which bounds what a task holds.

Defined results: null html is an empty payload; empty and short payloads are
always responses; a null page_id counts as the smallest, and equal payloads all
without an id are responses; rows that repeat the largest page_id are each a
response; an empty table writes no archive and gives no rows; other columns are
not read. A damaged archive, index or record raises.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumble.llm.shared import frame_of, keep, shared_path, with_package

LEAST = 1000  # bytes of a payload that may be revisited
ARCHIVE, MEMBER, RECORDS = 1 << 28, 1 << 25, 50_000
PART, READ = 1 << 24, 1 << 22  # bytes of records in a reading task, and in one read
LEVEL = 3
# Signatures and layouts of the ZIP format, names of the WARC format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_AT, END64_AT, LOCATOR_AT = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
CENTRAL_AT, LOCAL_AT, EXTRA_AT = struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H"), struct.Struct("<HH")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

ARCHIVES = "path string, bytes long, records long"
PLACES = "path string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_FRAME = "page_id:Int64 url:object payload_bytes:Int64 payload_digest:object record_type:object refers_to:Int64"

Read = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    stored: bool
    size: int
    header: int  # place of the local header


def directory(read: Read, size: int) -> list[Member]:
    """The members of a ZIP archive of ``size`` bytes, from its central directory."""
    tail_at = max(0, size - END_AT.size - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_AT.size + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)  # a signature inside the comment
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = END_AT.unpack_from(tail, at)
    ends = tail_at + at
    locator = read(ends - LOCATOR_AT.size, LOCATOR_AT.size) if ends >= LOCATOR_AT.size else b""
    if locator[:4] == LOCATOR:  # written where a field overflows, at times elsewhere too
        record = _end64(read, LOCATOR_AT.unpack(locator)[2])
        if record is None:  # bytes stand before the archive: the record lies right before its locator
            record = _end64(read, ends - LOCATOR_AT.size - END64_AT.size)
        if record is None:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = record[7:]
        ends -= LOCATOR_AT.size + 12 + record[1]
    elif count == FULL16 or FULL32 in (length, start):
        raise ValueError("no ZIP64 locator")
    shift = ends - length - start  # bytes before the archive, as in a self-extracting one
    if shift < 0:
        raise ValueError("the central directory is damaged")
    raw, at, members = read(start + shift, length), 0, []
    for _ in range(count):
        member, at = _central_entry(raw, at)
        members.append(member._replace(header=member.header + shift))
    return members


def _end64(read: Read, at: int) -> tuple | None:
    raw = read(at, END64_AT.size) if at >= 0 else b""
    return END64_AT.unpack(raw) if raw[:4] == END64 and len(raw) == END64_AT.size else None


def _central_entry(raw: bytes, at: int) -> tuple[Member, int]:
    if raw[at : at + 4] != CENTRAL or len(raw) < at + CENTRAL_AT.size:
        raise ValueError("the central directory is damaged")
    _, _, _, flags, method, _, _, _, packed, size, n_name, n_extra, n_comment, _, _, _, header = CENTRAL_AT.unpack_from(raw, at)
    at += CENTRAL_AT.size
    name, extra = raw[at : at + n_name], raw[at + n_name : at + n_name + n_extra]
    wide = [x == FULL32 for x in (size, packed, header)]
    if any(wide):
        values = list(_zip64_numbers(extra, sum(wide)))
        size, packed, header = (values.pop(0) if w else x for w, x in zip(wide, (size, packed, header), strict=True))
    member = Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method == 0 and not flags & 1 and size == packed, size, header)
    return member, at + n_name + n_extra + n_comment


def _zip64_numbers(extra: bytes, n: int) -> tuple[int, ...]:
    at = 0
    while at + EXTRA_AT.size <= len(extra):
        kind, length = EXTRA_AT.unpack_from(extra, at)
        if kind == 1 and length >= 8 * n:
            return struct.unpack_from(f"<{n}Q", extra, at + EXTRA_AT.size)
        at += EXTRA_AT.size + length
    raise ValueError("a member's ZIP64 numbers are missing")


def data_start(read: Read, member: Member) -> int:
    """Place of a stored member's first byte; the local header has its own lengths of name and extra."""
    head = LOCAL_AT.unpack(read(member.header, LOCAL_AT.size))
    if head[0] != LOCAL:
        raise ValueError(f"{member.name}: no local header")
    if not member.stored:
        raise ValueError(f"{member.name} is not stored, so its records have no place of their own")
    return member.header + LOCAL_AT.size + head[9] + head[10]


def places(read: Read, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of every WARC record of an archive."""
    members = {m.name: m for m in directory(read, size)}
    starts: dict[str, int] = {}
    for name, member in members.items():
        if not name.endswith(".cdxj"):
            continue
        for line in _lines(read, data_start(read, member), member.size):
            entry = json.loads(line.split(b" ", 2)[2])
            named = members.get(entry["filename"]) or members.get(f"archive/{entry['filename']}")
            if named is None:
                raise ValueError(f"{name} names {entry['filename']}, which the archive has not")
            if named.name not in starts:
                starts[named.name] = data_start(read, named)
            at, length = int(entry["offset"]), int(entry["length"])
            if at < 0 or at + length > named.size:
                raise ValueError(f"{name} names a record outside {named.name}")
            yield starts[named.name] + at, length
    for name, member in members.items():
        if name not in starts and name.endswith((".warc", ".warc.gz")):
            yield from walk(read, data_start(read, member), member.size, name.endswith(".gz"))


def _lines(read: Read, start: int, size: int) -> Iterator[bytes]:
    rest = b""
    for at in range(0, size, READ):
        *whole, rest = (rest + read(start + at, min(READ, size - at))).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def walk(read: Read, start: int, size: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Places of the records of a member without an index; one read's bytes are held."""
    at = 0
    while at < size:
        length = (_gzip_length if packed else _plain_length)(read, start + at, size - at)
        yield start + at, length
        at += length


def _gzip_length(read: Read, start: int, most: int) -> int:
    unpack, at = zlib.decompressobj(31), 0
    while not unpack.eof:
        if at >= most:
            raise ValueError("a record is damaged")
        raw = read(start + at, min(READ, most - at))
        at += len(raw)
        unpack.decompress(raw)
    return at - len(unpack.unused_data)


def _plain_length(read: Read, start: int, most: int) -> int:
    raw = read(start, min(1 << 16, most))
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record is damaged")
    return end + 4 + int(_headers(raw[:end])["content-length"]) + 4


def _headers(raw: bytes) -> dict[str, str]:
    named = (line.split(":", 1) for line in raw.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, value in named}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, gzipped or plain."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, found, block = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not found:
        raise ValueError("a record is damaged")
    headers = _headers(head)
    size = int(headers["content-length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is damaged")
    return headers, block[:size]


def page_of(uri: str) -> int | None:
    name = uri.rsplit(":", 1)[1].rstrip(">")
    return None if name == "null" else int(name)


def record_row(raw: bytes) -> tuple | None:
    """A row of ``RECORD``; a response's payload is checked against its digest. Records of other types give none."""
    headers, block = parse(raw)
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)["content-length"]), base64.b32decode(headers["warc-payload-digest"].split(":", 1)[1]).hex()
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload is damaged")
    refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
    return page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, refers


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzipped record: a response with its payload, or a revisit of page ``refers_to``."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress(b"\r\n".join([VERSION, *(x.encode() for x in lines), b"", block, b"", b""])) + pack.flush()


class _Stream:
    """The writing end of a store, which cannot seek."""

    def __init__(self, f: pa.NativeFile):
        self.write, self.flush = f.write, f.flush


class Archive:
    """An archive that is being written; at most one member's index is held."""

    def __init__(self, fs: pafs.FileSystem, folder: str, path: str):
        self.path, self.bytes, self.records, self.members = path, 0, 0, 0
        self.out = fs.open_output_stream(f"{folder}/{path}", buffer_size=1 << 20)
        self.zip, self.member, self.index, self.at = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED), None, [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.member is None:
            self.name = f"archive/{self.members:04d}.warc.gz"
            self.member = self.zip.open(self.name, "w", force_zip64=True)
        self.member.write(data)
        entry = json.dumps({"filename": self.name, "offset": self.at, "length": len(data)})
        self.index.append(f"page:{'null' if page_id is None else page_id} {re.sub('[^0-9]', '', DATE)} {entry}\n")
        self.at += len(data)
        self.bytes += len(data)
        self.records += 1
        if self.at >= MEMBER or len(self.index) >= RECORDS:
            self.end_member()

    def end_member(self) -> None:
        if self.member is None:
            return
        self.member.close()
        self.zip.writestr(f"indexes/{self.members:04d}.cdxj", "".join(self.index))
        self.member, self.index, self.at, self.members = None, [], 0, self.members + 1

    def close(self) -> tuple[str, int, int]:
        self.end_member()
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, self.records


def with_decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for a response.

    Groups of equal payloads are found on narrow rows and written; Spark reads
    their size and sends them to the pages where it is small, else it shuffles
    the pages, parting a frequent digest."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = keep(groups.filter("n > 1 AND keep_id IS NOT NULL").select(F.col("digest").alias("met"), "keep_id"), "warc-groups")
    met = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))  # short ones meet nothing
    joined = rows.withColumn("met", met).join(groups, "met", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keep_id")), F.col("keep_id")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str, **columns) -> DataFrame:
    """Write every page's record below ``out``; returns the list of archives, kept at ``out``/archives."""
    spark = pages.sparkSession
    with_package(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{folder}/zip", recursive=True)
        archive = None
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                archive = archive or Archive(fs, folder, f"zip/{uuid.uuid4().hex}.zip")
                archive.add(page_id, record(page_id, url, payload, digest, refers_to))
                if archive.bytes >= ARCHIVE:
                    yield _batch(archive.close())
                    archive = None
        if archive is not None:
            yield _batch(archive.close())

    def _batch(row: tuple[str, int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int64())], ["path", "bytes", "records"])

    with_decisions(pages, **columns).mapInArrow(write, ARCHIVES).write.parquet(f"{out}/archives")
    return spark.read.schema(ARCHIVES).parquet(f"{out}/archives")


def _reader(fs: pafs.FileSystem, path: str) -> tuple[pa.NativeFile, Read]:
    f = fs.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        if at < 0:
            raise ValueError(f"{path} is damaged")
        f.seek(at)
        return f.read(n)

    return f, read


def archive_places(archives: DataFrame, out: str) -> DataFrame:
    """(path, offset, length) of every record of the archives (path, ...) below ``out``."""
    with_package(archives.sparkSession)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pafs.FileSystem.from_uri(out)
        for path in (p for f in frames for p in f["path"]):
            f, read = _reader(fs, f"{folder}/{path}")
            rows = []
            with f:
                for at, length in places(read, f.size()):
                    rows.append((path, at, length))
                    if len(rows) == RECORDS:
                        yield frame_of(rows, "path:object offset:Int64 length:Int64")
                        rows = []
            yield frame_of(rows, "path:object offset:Int64 length:Int64")

    return archives.select("path").repartition(max(1, archives.count())).mapInPandas(find, PLACES)  # a task per archive


def read_places(found: DataFrame, out: str) -> DataFrame:
    """The records (``RECORD``) at the places (path, offset, length), about
    ``PART`` bytes of neighbours in a task, read ``READ`` bytes at a time."""
    with_package(found.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = pafs.FileSystem.from_uri(out)
        f = read = None
        path, held, held_at = None, b"", 0
        for frame in frames:
            rows = []
            for name, at, length in zip(frame["path"], frame["offset"].tolist(), frame["length"].tolist(), strict=True):
                if name != path:
                    if f is not None:
                        f.close()
                    path, held = name, b""
                    f, read = _reader(fs, f"{folder}/{name}")
                if not held_at <= at <= at + length <= held_at + len(held):
                    held, held_at = read(at, max(READ, length)), at
                rows.append(record_row(held[at - held_at : at - held_at + length]))
            yield frame_of([r for r in rows if r], RECORD_FRAME)
        if f is not None:
            f.close()

    total = found.agg(F.sum("length")).first()[0] or 0
    return found.repartitionByRange(-(-total // PART) or 1, "path", "offset").sortWithinPartitions("path", "offset").mapInPandas(run, RECORD)


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """Every record (``RECORD``) of the archives listed at ``out``/archives."""
    return read_places(keep(archive_places(spark.read.schema(ARCHIVES).parquet(f"{out}/archives"), out), "warc-places"), out)


def warc_round_trip(pages: DataFrame, out: str | None = None, **columns) -> DataFrame:
    """Write the archives, read them back: one row per page."""
    out = out or shared_path(pages.sparkSession, "warc")
    write_archives(pages, out, **columns)
    return read_archives(pages.sparkSession, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
