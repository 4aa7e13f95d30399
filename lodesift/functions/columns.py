"""The scalar functions as Spark columns, for plans that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.values import IGNORE_TAG, MASK, SHOWN


def entropy(text: Column) -> Column:
    """Shannon entropy of the bytes of a text in bits. Bytes are told apart by their hex digits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    data = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    n = F.size(data)
    shares = F.transform(F.array_distinct(data), lambda b: F.size(F.filter(data, lambda x: x == b)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))).otherwise(F.lit(0.0))


def redact(text: Column) -> Column:
    return F.when(F.length(text) <= SHOWN, F.lit(MASK)).otherwise(F.concat(F.lit(MASK), F.right(text, F.lit(SHOWN))))


def redact_prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + MASK), F.right(text, F.lit(SHOWN)))


def byte_offset(before: Column) -> Column:
    """Byte offset after a prefix of the text."""
    return F.octet_length(before).cast("long")


def line_number(before: Column) -> Column:
    """1-based line that follows a prefix of the text."""
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def finding_id(detector_id: Column, redacted: Column, path: Column, line: Column, offset: Column) -> Column:
    return F.substring(F.sha2(F.concat(detector_id, redacted, path, line.cast("string"), F.lit(":"), offset.cast("string")), 256), 1, 32)


def line_ignored(line: Column, detector_id: str, tag: str = IGNORE_TAG) -> Column:
    bare = F.substring_index(line, tag, 1) != line
    after = F.substring(line, F.length(F.substring_index(line, tag, 1)) + len(tag) + 1, F.lit(1))
    own = line.rlike(rf"\Q{tag}:{detector_id}\E(?![A-Za-z0-9-])")
    return own | (bare & (after != ":"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), severity).cast("int") - 1


def binary(data: Column) -> Column:
    """Whether bytes look binary: a NUL in the first 8192, unless a UTF-16 mark starts them."""
    head = F.hex(F.substring(data, 1, 8192))
    marked = head.startswith("FFFE") | head.startswith("FEFF")
    return ~marked & head.rlike("^(?:..)*?00")


def csv_cell(text: Column) -> Column:
    return F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def displayable(text: Column) -> Column:
    """Control characters dropped; those that turn the direction of text escaped."""
    out = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "")
    for c in (*range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x061C, 0x200E, 0x200F):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04X}"))
    return out


def escape_command(text: Column, in_property: bool = False) -> Column:
    """Text in a workflow command: percent and line ends escaped, in properties colons and commas too."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *([(":", "%3A"), (",", "%2C")] if in_property else [])]
    for c, by in pairs:
        text = F.replace(text, F.lit(c), F.lit(by))
    return displayable(text)


def scrub_url(text: Column) -> Column:
    """A repository address without its login."""
    return F.regexp_replace(text, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
