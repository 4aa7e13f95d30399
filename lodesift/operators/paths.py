"""Which files a scan leaves out by name or content."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.columns import binary
from lodesift.functions.globs import covers

#: Lock files, whose checksums look like secrets.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Cargo.lock", "poetry.lock", "go.sum", "Pipfile.lock")
#: Extensions of files that hold no text.
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".avi", ".mov",
    ".zip", ".tar", ".gz", ".bz2", ".rar", ".7z", ".xz", ".pdf", ".woff", ".woff2", ".ttf", ".eot",
)
LARGEST = 10 << 20


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the last segment on, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def lock_file(path: Column) -> Column:
    return base_name(path).isin(*LOCK_FILES)


def excluded_extension(path: Column, extra: Iterable[str] = ()) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS, *[e.lower() for e in extra])


def skipped(path: Column, extra: Iterable[str] = (), globs: Iterable[str] = ()) -> Column:
    """Whether a path is left out by its name alone, so that its content needn't be read."""
    return lock_file(path) | excluded_extension(path, extra) | covers(path, globs)


def scannable(path: Column, size: Column, content: Column, extra: Iterable[str] = (), globs: Iterable[str] = (), largest: int = LARGEST) -> Column:
    return ~skipped(path, extra, globs) & (size <= largest) & ~binary(content)
