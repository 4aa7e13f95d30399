"""What the address of a repository means."""

from __future__ import annotations

import re

REMOTE = ("http", "https", "ssh")


def classify(target: str) -> tuple[bool, str]:
    """(whether it is remote, the address with its scheme lower-cased). A path, with a drive's letter too, is local; a
    scheme that isn't one of REMOTE is an error and never read as a path."""
    if target.startswith("git@"):
        return True, target
    if re.match(r"[A-Za-z]:[/\\]", target) or "://" not in target:
        return False, target
    scheme, rest = target.split("://", 1)
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme) or re.search(r"[\x00-\x20\x7f]", rest):
        raise ValueError("malformed address")
    if scheme.lower() not in REMOTE:
        raise ValueError(f"addresses of {scheme!r} aren't read")
    return True, f"{scheme.lower()}://{rest}"


def without_login(text: str) -> str:
    """A text in which no address has a login."""
    return re.sub(r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@", r"\1", text)
