"""Scalar functions over bytes and strings, as the scan calls them for each match."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

MASK = "****"
SHOWN = 4
#: The word that comments use to silence a finding; `<tag>:ignore` for all detectors, `<tag>:ignore:<id>` for one.
IGNORE_TAG = "lodesift:ignore"


def entropy(data: bytes) -> float:
    """Shannon entropy of the bytes in bits; 0 for none."""
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) + 0.0 if n else 0.0


def redact(value: bytes | str) -> str:
    """The mask and the last four characters; nothing shown of four or fewer."""
    text = value.decode("utf-8", "replace") if isinstance(value, bytes) else value
    return MASK if len(text) <= SHOWN else MASK + text[-SHOWN:]


def redact_prefixed(value: bytes, prefix: str) -> str:
    """A fixed prefix, the mask, and the last four bytes."""
    return prefix + MASK + value[-SHOWN:].decode("utf-8", "replace")


class Url(NamedTuple):
    scheme: str
    user: str | None
    password: str | None
    host: str
    request: str  # path and query, "/" if there is neither


_URL = re.compile(r"(?s)([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\Z")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_UNESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)


def parse_url(text: str) -> Url | None:
    """The parts of an absolute URL; None if a control character, an escape, the port or the host is malformed."""
    if re.search(r"[\x00-\x1f\x7f]", text) or not (m := _URL.match(text)):
        return None
    authority, path, query = m[2], m[3], m[4] or ""
    if _BAD_ESCAPE.search(authority) or _BAD_ESCAPE.search(path):
        return None
    login, at, host = authority.rpartition("@")
    if re.search(r"[ \"<>\\^`{|}]", host) or not re.fullmatch(r"(\[[^\]]*\]|[^:\[\]]*)(:[0-9]*)?", host):
        return None
    user, colon, password = login.partition(":")
    return Url(m[1].lower(), unescape(user) if at else None, unescape(password) if colon else None, host, (path or "/") + query)


def redact_url(value: bytes) -> str:
    """A URL with its password masked; what can't be parsed is masked whole, and all after the scheme if there
    is no login."""
    url = parse_url(value.decode("utf-8", "replace"))
    if url is None:
        return MASK
    return f"{url.scheme}://{url.user}:{MASK}@{url.host}{url.request}" if url.user is not None else f"{url.scheme}://{MASK}"


def redact_url_or_keep(value: bytes) -> str:
    """As redact_url, but a URL without a login has nothing to mask."""
    text = value.decode("utf-8", "replace")
    url = parse_url(text)
    return text if url is not None and url.user is None else redact_url(value)


def line_at(data: bytes, offset: int) -> int:
    """1-based line of a byte offset."""
    return data.count(b"\n", 0, offset) + 1


def line_text(data: bytes, offset: int) -> bytes:
    """The line that holds a byte offset, without its end."""
    start, end = data.rfind(b"\n", 0, offset) + 1, data.find(b"\n", offset)
    return data[start : len(data) if end < 0 else end].removesuffix(b"\r")


def nth_line(data: bytes, number: int) -> bytes:
    """The text of a 1-based line, empty if there is none."""
    start = 0
    for _ in range(number - 1):
        start = data.find(b"\n", start) + 1
        if not start:
            return b""
    return line_text(data, start) if number > 0 else b""


def finding_id(detector_id: str, redacted: str, path: str, line: int, offset: int) -> str:
    """32 hex digits that the same match always gets."""
    return hashlib.sha256(f"{detector_id}{redacted}{path}{line}:{offset}".encode("utf-8", "surrogatepass")).hexdigest()[:32]


def ignored(line: bytes, detector_id: str, tag: str = IGNORE_TAG) -> bool:
    """Whether a line's marker covers a detector. A marker with an id covers that id alone; whether a bare
    marker is there is judged by the first tag on the line."""
    first = line.find(tag.encode())
    if first < 0:
        return False
    if re.search(re.escape(f"{tag}:{detector_id}").encode() + rb"(?![A-Za-z0-9-])", line):
        return True
    return line[first + len(tag) : first + len(tag) + 1] != b":"


_BIDI = re.compile("[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]")
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")


def displayable(text: str) -> str:
    """Text for a terminal: control characters dropped, those that turn the direction of text escaped."""
    return _BIDI.sub(lambda m: f"\\u{ord(m[0]):04X}", _CONTROL.sub("", text))


def csv_cell(text: str) -> str:
    """A cell that no spreadsheet takes for a formula."""
    return f"'{text}" if text[:1] in ("=", "+", "-", "@", "\t", "\r") and text else text
