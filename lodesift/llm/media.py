"""Media columns: typed by signature, checked by structure, carved from what surrounds them.

One Aho-Corasick automaton finds the magic bytes of all formats in one pass over the bytes; a validator of the
format then walks its structure and tells its length, or that it isn't one. The declared type gives way to
what is confirmed at the start; what is confirmed further on is embedded media, which inspected() carves out.

digest() makes each text a media value in a binary column and reads that column back; the column is where the
value is stored, and is not written to a file of its own.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import map_arrow, text_bytes

BLOCK = 576
FILL = b"\xff"
RATE = 8000
TAIL = 32
UNKNOWN = "application/octet-stream"


def _png(data: Marks, at: int) -> int:
    """Each validator: the length of the media at a position, 0 if it isn't whole and well-formed."""
    if bytes(data[at : at + 8]) != b"\x89PNG\r\n\x1a\n":
        return 0
    i = at + 8
    while i + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[i : i + 8])
        end = i + 12 + n
        if end > len(data) or zlib.crc32(data[i + 4 : end - 4]) != struct.unpack(">I", data[end - 4 : end])[0] or (i == at + 8) != (kind == b"IHDR"):
            return 0
        if kind == b"IEND":
            return end - at
        i = end
    return 0


def _gif(data: Marks, at: int) -> int:
    if len(data) < at + 13:
        return 0
    flags = data[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(data) and data[i]:
            i += data[i] + 1
        return i + 1

    while i < len(data):
        mark = data[i]
        if mark == 0x3B:
            return i + 1 - at
        if mark == 0x21:
            i = blocks(i + 2)
        elif mark == 0x2C and i + 10 <= len(data):
            local = data[i + 9]
            i = blocks(i + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            return 0
    return 0


class Marks(bytes):
    """Bytes that remember where their markers are, so that no validator looks through all that follows."""

    def places(self, mark: bytes) -> list[int]:
        known = self.__dict__.setdefault("known", {})
        if mark not in known:
            known[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        return known[mark]

    def next(self, mark: bytes, at: int) -> int:
        places = self.places(mark)
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def last(self, mark: bytes, lo: int, hi: int) -> int:
        places = self.places(mark)
        k = bisect.bisect_left(places, hi) - 1
        return places[k] if k >= 0 and places[k] >= lo else -1

    @functools.cached_property
    def jpeg_markers(self) -> list[int]:
        """Where entropy-coded data would end: at 255 and what is neither stuffing nor a restart."""
        return [m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7]", self, re.S)]

    @functools.cached_property
    def zip_ends(self) -> dict[int, int]:
        """Of each archive whose end record fits what stands before it: its start, and its end."""
        out = {}
        for end in self.places(b"PK\5\6"):
            if end + 22 <= len(self):
                size, start, note = struct.unpack("<IIH", self[end + 12 : end + 22])
                at = end - size - start
                if at >= 0 and end + 22 + note <= len(self) and (size == 0 or self[at + start : at + start + 4] == b"PK\1\2"):
                    out.setdefault(at, end + 22 + note)
        return out


def _jpeg(data: Marks, at: int) -> int:
    i = at + 2
    while i + 4 <= len(data) and data[i] == 0xFF:
        kind = data[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        n = struct.unpack(">H", data[i + 2 : i + 4])[0]
        if n < 2:
            return 0
        i += 2 + n
        if kind == 0xDA:  # entropy-coded data up to a marker
            k = bisect.bisect_left(data.jpeg_markers, i)
            if k == len(data.jpeg_markers):
                return 0
            i = data.jpeg_markers[k]
            if data[i + 1] == 0xD9:
                return i + 2 - at
    return 0


def _riff(data: Marks, at: int, form: bytes) -> int:
    if len(data) < at + 12 or bytes(data[at + 8 : at + 12]) != form:
        return 0
    end = at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
    i, kinds = at + 12, []
    while i + 8 <= min(end, len(data)):
        kind, n = struct.unpack("<4sI", data[i : i + 8])
        kinds.append(kind)
        i += 8 + n + (n & 1)
    whole = end <= len(data) and i == end
    return end - at if whole and (form != b"WAVE" or kinds[:1] == [b"fmt "] and b"data" in kinds) and kinds else 0


def _wav(data: Marks, at: int) -> int:
    return _riff(data, at, b"WAVE")


def _webp(data: Marks, at: int) -> int:
    return _riff(data, at, b"WEBP")


def _bmp(data: Marks, at: int) -> int:
    if len(data) < at + 26:
        return 0
    n, rest, start, head = struct.unpack("<IIII", data[at + 2 : at + 18])
    return n if rest == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n <= len(data) - at else 0


def _pdf(data: Marks, at: int) -> int:
    if not data[at + 5 : at + 6].isdigit():
        return 0
    following = data.next(b"%PDF-", at + 5)
    last = data.last(b"%%EOF", at + 5, following if following > 0 else len(data))
    return last + 5 - at if last > 0 and data.last(b"startxref", at + 5, last) > 0 else 0


def _zip(data: Marks, at: int) -> int:
    return data.zip_ends.get(at, at) - at


def _gzip(data: Marks, at: int) -> int:
    inflate = zlib.decompressobj(31)
    i = at
    try:
        while i < len(data) and not inflate.eof:
            inflate.decompress(data[i : i + (1 << 16)], 1 << 20)
            while inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            i += 1 << 16
    except zlib.error:
        return 0
    return min(i, len(data)) - len(inflate.unused_data) - at if inflate.eof else 0


def _ogg(data: Marks, at: int) -> int:
    i, last = at, False
    while i + 27 <= len(data) and bytes(data[i : i + 4]) == b"OggS" and data[i + 4] == 0:
        n = data[i + 26]
        end = i + 27 + n + sum(data[i + 27 : i + 27 + n])
        if end > len(data):
            return 0
        last, i = bool(data[i + 5] & 4), end
        if last:
            break
    return i - at if last else 0


@dataclass(frozen=True)
class Format:
    name: str
    magic: bytes
    length: Callable[[Marks, int], int]


#: Registered media types and the magic bytes that the formats' standards give.
FORMATS = (
    Format("image/png", b"\x89PNG", _png),
    Format("image/gif", b"GIF87a", _gif),
    Format("image/gif", b"GIF89a", _gif),
    Format("image/jpeg", b"\xff\xd8\xff", _jpeg),
    Format("image/bmp", b"BM", _bmp),
    Format("image/webp", b"RIFF", _webp),
    Format("audio/wav", b"RIFF", _wav),
    Format("audio/ogg", b"OggS", _ogg),
    Format("application/pdf", b"%PDF-", _pdf),
    Format("application/zip", b"PK\x03\x04", _zip),
    Format("application/gzip", b"\x1f\x8b\x08", _gzip),
)

_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for magic in {f.magic for f in FORMATS}:
            made.add_word(magic.decode("latin-1"), magic)
        made.make_automaton()
        _automaton = made
    return _automaton


def marks(data: bytes) -> list[tuple[int, bytes]]:
    """(start, magic bytes) of all magic bytes in data, in order: one pass."""
    return sorted((end + 1 - len(magic), magic) for end, magic in automaton().iter(data.decode("latin-1")))


def confirmed(data: bytes, found: list[tuple[int, bytes]] | None = None, past: int = 0) -> list[tuple[int, int, str]]:
    """(start, length, type) of all well-formed media in data from a position on, none within another, in order."""
    view, out = data if isinstance(data, Marks) else Marks(data), []
    for start, magic in marks(data) if found is None else found:
        if start < past:
            continue
        for form in FORMATS:
            if form.magic == magic and (n := form.length(view, start)):
                out.append((start, n, form.name))
                past = start + n
                break
    return out


def sniff(data: bytes, declared: str | None = None) -> tuple[str, int, list[tuple[int, int, str]]]:
    """The type that data has, its length, and the media embedded in it or after it. Without a confirmed type
    at its start, a declared type that has a signature here is taken back; another one stands."""
    data = Marks(data)
    found = marks(data)
    first = confirmed(data, found[:1]) if found and found[0][0] == 0 else []
    if not first:
        return (UNKNOWN if declared is None or declared in {f.name for f in FORMATS} else declared), len(data), confirmed(data, found)
    _, n, kind = first[0]
    return kind, n, confirmed(data, found, chunk(data, b"data")[0] if kind == "audio/wav" else n)


CARVED = "array<struct<media_type:string,start:bigint,length:bigint,content:binary>>"


def inspected(media: DataFrame, id_col: str, media_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, declared, media_type, corrected, length, carved) for each row of a table with a column of media and one of
    their declared types: the type that the bytes have, whether it isn't the declared one, its length, and the
    well-formed media that stand within or after it, each with its type, place and bytes.

    Null and empty values have the type application/octet-stream unless another one without a signature is declared,
    length 0, and nothing to carve; ids, repeated rows and nulls stay as they are; an empty table gives no rows; other
    columns aren't read, whatever their names."""
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    chosen = media.select(F.col(id_col).alias("id"), declared.alias("declared"), F.col(media_col).cast("binary").alias("media"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for told, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = value or b""
            kind, n, within = sniff(data, told)
            rows.append((kind, kind != told, n, [{"media_type": k, "start": at, "length": size, "content": data[at : at + size]} for at, size, k in within]))
        carved = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
        kinds = (pa.string(), pa.bool_(), pa.int64(), carved)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["id", "declared", "media_type", "corrected", "length", "carved"])

    kind = chosen.schema["id"].dataType.simpleString()
    return map_arrow(chosen, step, f"id {kind}, declared string, media_type string, corrected boolean, length long, carved {CARVED}")


def to_wav(payload: bytes) -> bytes:
    """Payload bytes as unsigned 8-bit samples, one channel."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def chunk(wav: bytes, name: bytes) -> tuple[int, int]:
    """Start and length of a RIFF file's chunk."""
    i = 12
    while i + 8 <= len(wav):
        kind, n = struct.unpack("<4sI", wav[i : i + 8])
        if kind == name:
            return i + 8, n
        i += 8 + n + (n & 1)
    raise ValueError(f"no chunk {name!r}")


def samples(wav: bytes) -> bytes:
    start, n = chunk(wav, b"data")
    return wav[start : start + n]


def padded(text: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of BLOCK."""
    return text + FILL * ((-len(text)) % BLOCK if text else BLOCK)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """(doc_id, n_bytes long, declared string, media binary): each text as a media value. Null is empty."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column(1)).to_pylist()
        media = pa.array([to_wav(padded(x)) for x in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([declared] * len(texts)), media], names=["doc_id", "n_bytes", "declared", "media"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), step, "doc_id long, n_bytes long, declared string, media binary")


def feature(kind: str, body: bytes, embedded: list[tuple[int, int, str]]) -> str:
    """Of the samples: number, mean, energy, crossings of the middle; and what is embedded."""
    x = np.frombuffer(body, np.uint8)
    above = x >= 128
    sums = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    crossings = int((above[1:] != above[:-1]).sum())
    return f"{kind};samples={len(x)};mean={sums[0] / len(x):.6f};energy={sums[1] / len(x):.6f};crossings={crossings};embedded=" + "|".join(f"{k}@{start}+{n}" for start, n, k in embedded)


def read_back(media: DataFrame) -> DataFrame:
    """Of store()'s rows: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, media_type), from the stored bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for declared, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            kind, _, embedded = sniff(data, declared)
            body = samples(data)
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature(kind, body, embedded), kind))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type"]
    return map_arrow(media, step, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as media and read back, a row for each row of docs.

    Null and empty texts give one block of bytes 255; repeated rows stay repeated and equal texts give equal
    values; an empty table gives no rows; other columns aren't read."""
    return read_back(store(docs, id_col, text_col))
