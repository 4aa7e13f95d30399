"""WARC files packed in ZIP archives, written and read by range.

An archive holds, as stored members, one file of gzipped WARC records and an index of where each record is. The
reader parses the end record, the ZIP64 records if there are any, and the central directory, finds the two
members, and reads single records by range; no member is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import fresh_path, materialize, partitions

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are recorded once.
REVISIT_BYTES = 0
#: Records of an archive, and bytes of their payloads, about.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1000, 32 << 20


class RangeReader(Protocol):
    def size(self) -> int: ...
    def read(self, start: int, n: int) -> bytes: ...


class BytesReader:
    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read(self, start: int, n: int) -> bytes:
        return self.data[start : start + n]


class FileReader:
    """Ranges of a file in any store that Arrow's file systems open by its address."""

    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def close(self) -> None:
        self.file.close()


# ZIP


class ZipWriter:
    """A ZIP archive of stored members, written in one pass: sizes and checksums follow each member and stand in the
    central directory. ZIP64 records are written where sizes need them, or all over if asked for."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.zip64, self.at = out, zip64, 0
        self.members: list[tuple[bytes, int, int, int]] = []  # name, start, checksum, size

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterable[bytes]) -> None:
        raw, start, crc, size = name.encode(), self.at, 0, 0
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if self.zip64 else 20, 0x808, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._write(part)
        self._write(struct.pack("<4sIQQ" if self._large(size) else "<4sIII", b"PK\7\10", crc, size, size))
        self.members.append((raw, start, crc, size))

    def _large(self, *values: int) -> bool:
        return self.zip64 or max(values) >= 0xFFFFFFFF

    def close(self) -> None:
        start = self.at
        for raw, at, crc, n in self.members:
            large = self._large(at, n)
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
            version, shown = (45, 0xFFFFFFFF) if large else (20, n)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", version, version, 0x808, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if large else at) + raw + extra)
        end, count = self.at, len(self.members)
        if self._large(start, end - start) or count >= 0xFFFF:
            self._write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, end - start, start))
            self._write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, end - start, start, 0))


def zip_members(reader: RangeReader) -> dict[str, tuple[int, int, int]]:
    """(method, start of the data, its stored length) of each member, from the central directory."""
    size = reader.size()
    tail_at = max(0, size - 65557)
    tail = reader.read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = reader.read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = reader.read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory = reader.read(start, length)
    out, i = {}, 0
    for _ in range(count):
        if directory[i : i + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, stored, whole = struct.unpack("<H", directory[i + 10 : i + 12])[0], *struct.unpack("<II", directory[i + 20 : i + 28])
        names, extras, notes = struct.unpack("<HHH", directory[i + 28 : i + 34])
        local = struct.unpack("<I", directory[i + 42 : i + 46])[0]
        name = directory[i + 46 : i + 46 + names].decode()
        j, end = i + 46 + names, i + 46 + names + extras
        while j + 4 <= end:
            kind, n = struct.unpack("<HH", directory[j : j + 4])
            if kind == 1:  # wide values stand for those that are all ones, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", directory[j + 4 : j + 4 + n // 8 * 8]))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                local = next(wide) if local == 0xFFFFFFFF else local
            j += 4 + n
        head = reader.read(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        names_here, extras_here = struct.unpack("<HH", head[26:30])
        out[name] = method, local + 30 + names_here + extras_here, stored
        i = end + notes
    return out


# WARC


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    """A URL as a header's value: controls, spaces and what isn't ASCII percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has no payload, but tells its digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base32_sha1(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        first = uuid.uuid5(uuid.NAMESPACE_URL, f"{refers_to}:{digest}")
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{first}>", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and the payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = lambda x: {k.lower(): v.strip() for k, _, v in (y.partition(":") for y in x)}
    warc = headers(lines[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http.decode().split("\r\n")[1:]), payload


def write_archive(out: BinaryIO, records: Iterator[tuple[int | None, bytes]], zip64: bool = False) -> None:
    """A ZIP archive of (page id, record): the data member, record by record, and its index, both stored."""
    index, at = [], 0

    def members() -> Iterator[bytes]:
        nonlocal at
        for page_id, raw in records:
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = deflate.compress(raw) + deflate.flush()
            index.append(f"{'-' if page_id is None else page_id} " + json.dumps({"offset": at, "length": len(member), "filename": DATA}))
            at += len(member)
            yield member

    made = ZipWriter(out, zip64)
    made.member(DATA, members())
    made.member(INDEX, [("\n".join(index) + "\n").encode()])
    made.close()


def read_records(reader: RangeReader) -> Iterator[bytes]:
    """Each record of an archive, by a range read of its own."""
    members = zip_members(reader)
    for name, (method, start, n) in members.items():
        if not name.startswith("indexes/"):
            continue
        if method != 0:
            raise ValueError(f"{name} isn't stored")
        for line in reader.read(start, n).decode().splitlines():
            where = json.loads(line.partition(" ")[2])
            method, base, _ = members[where["filename"]]
            if method != 0:
                raise ValueError(f"{where['filename']} isn't stored")
            yield zlib.decompress(reader.read(base + where["offset"], where["length"]), 31)


# Spark


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Writes all pages to archives in a folder that the executors share; (path, records), a row an archive.

    Of the rows with one payload of at least revisit_bytes, those with the largest id are responses; the
    others, null ids among them, revisit it. If all ids of a payload are null, all are responses. Null html is
    an empty payload. Archives hold about so many records and bytes, whichever is fewer; records are written one after
    the other. Files are written under another name and then renamed, so a task that is run again leaves the
    same files, and what a failed one has written is deleted."""
    rows, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(html_col).cast("long"))).first()
    count = max(1, -(-rows // archive_records), -(-(size or 0) // ARCHIVE_BYTES))
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    chosen = chosen.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("archive", F.pmod(F.xxhash64("page_id", "digest"), F.lit(count)))
    shared = chosen.where(F.octet_length("html") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("digest", "last")
    revisits = chosen.select("archive", "digest").join(shared, "digest").select(F.col("archive").alias("of"), F.col("digest").alias("sha1"), "last").distinct()

    def write(key: tuple[pa.Scalar, ...], pages: pa.Table, known: pa.Table) -> pa.Table:
        last = dict(zip(known["sha1"].to_pylist(), known["last"].to_pylist(), strict=True))
        rows = sorted(zip(*[pages[c].to_pylist() for c in ("page_id", "digest", "url", "html")], strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or ""))

        def records() -> Iterator[tuple[int | None, bytes]]:
            for page_id, digest, url, html in rows:
                first = last.get(digest)
                yield page_id, record(page_id, url, html.encode("utf-8", "surrogatepass"), first, first is not None and page_id != first)

        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{key[0].as_py():08d}.wacz"
        passing = f"{base}/.{name}.{uuid.uuid4().hex}"
        try:
            with store.open_output_stream(passing) as out:
                write_archive(out, records())
            store.move(passing, f"{base}/{name}")
        except BaseException:
            if store.get_file_info(passing).type == pafs.FileType.File:
                store.delete_file(passing)
            raise
        return pa.table({"path": [f"{folder}/{name}"], "records": pa.array([len(rows)], pa.int64())})

    return chosen.groupBy("archive").cogroup(revisits.groupBy("of")).applyInArrow(write, "path string, records long")


def read_archives(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """All records of the archives named: (page_id, payload_bytes, payload_digest, record_type, refers_to). The
    length and digest of a response are those of the payload that is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                reader = FileReader(path)
                for raw in read_records(reader):
                    warc, http, payload = parse(raw)
                    said = warc["warc-payload-digest"].removeprefix("sha1:")
                    revisit = warc["warc-type"] == "revisit"
                    if not revisit and base32_sha1(payload) != said:
                        raise ValueError(f"{path}: a payload's digest isn't what its record tells")
                    number = lambda k: int(warc[k]) if k in warc else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), int(http["content-length"]) if revisit else len(payload), said, warc["warc-type"], number("x-refers-to-page-id")))
                reader.close()
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = manifest.select(path_col).repartition(partitions(manifest.sparkSession), path_col)
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, a row for each row of pages.

    Null html is an empty payload; repeated rows are records each; rows with a null id count like others, and are
    responses if no row of their payload has an id; an empty table gives no rows. Only the three columns named are
    read, so others may have any name."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(materialize(write_archives(pages, folder, id_col, url_col, html_col), "manifest"))


_BITS = "array_to_string(list_transform(string_split(sha1(encode(html)), ''), lambda h: lpad(bin(strpos('0123456789abcdef', h) - 1), 4, '0')), '')"
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{1 << 4 - k} * substr(bits, {k + 1} + 5 * i::INTEGER, 1)::INTEGER" for k in range(5)) + ", 1)"
#: What round_trip() returns, from the table alone: REVISIT_BYTES is 0, so payloads of any size are recorded once.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, {_BITS} AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {_DIGIT}), '') AS payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""
