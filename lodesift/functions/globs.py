"""Path patterns as regular expressions, the same for Python and for Spark's rlike."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"([\\.^$|?*+()\[\]{}])")


def _segment(glob: str) -> str | None:
    """`*`, `?`, `[...]` and escapes within one path segment; None if the pattern is malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += _ESCAPE.sub(r"\\\1", glob[i])
        elif c == "[":
            end = i + 1 + glob[i + 1 :].startswith("^")
            items = ""
            while True:
                if end >= len(glob) or (glob[end] == "]" and not items):
                    return None
                if glob[end] == "]":
                    break
                low = end + (glob[end] == "\\")
                if low >= len(glob) or glob[low] in "-":
                    return None
                high = low
                if glob[low + 1 : low + 2] == "-":
                    high = low + 2 + (glob[low + 2 : low + 3] == "\\")
                    if high >= len(glob) or glob[high] == "]":
                        return None
                items += f"\\x{{{ord(glob[low]):x}}}-\\x{{{ord(glob[high]):x}}}" if high > low else f"\\x{{{ord(glob[low]):x}}}"
                end = high + 1
            negated = glob[i + 1] == "^"
            out += "[^/" + items + "]" if negated else f"[{items}]"
            i = end
        else:
            out += _ESCAPE.sub(r"\\\1", c)
        i += 1
    return out


def to_regex(glob: str) -> str | None:
    """A regular expression that finds a path the glob covers; None for a glob that covers nothing.

    Plain globs hold for the whole path or for its last segment; `dir/` holds for all in a directory of that
    name; `**` stands for any number of segments."""
    glob = glob.replace("\\", "/") if "**" not in glob and not glob.endswith("/") else glob
    if glob.endswith("/") and glob != "/" and "**" not in glob:
        body = _segment(glob[:-1])
        return None if body is None or "/" in glob[:-1] else f"(?:^|/){body}/+[^/]"
    if "**" not in glob:
        body = _segment(glob)
        return None if body is None else (f"^(?:{body})\\z" if "/" in glob else f"(?:^|/)(?:{body})\\z")
    out, parts = "^/*", [p for p in glob.split("/") if p]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += r"(?:[^/]+(?:/+|\z))*" if not last else r"(?:[^/]+(?:/+|\z))*"
            continue
        body = _segment(part)
        if body is None:
            return None
        out += body + (r"/*\z" if last else r"(?:/+|\z)")
    return out + (r"\z" if parts and parts[-1] == "**" else "")


def _python(regex: str) -> re.Pattern[str]:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), regex).replace("\\z", "\\Z"), re.S)


def matches(path: str, globs: Iterable[str]) -> bool:
    """Whether any glob covers a path."""
    path = path.replace("\\", "/")
    base = path.rstrip("/").rpartition("/")[2]
    for glob in globs:
        regex = to_regex(glob)
        if regex and (_python(regex).search(path) or ("**" in glob and _python(regex).search(base))):
            return True
    return False


def covers(path: Column, globs: Iterable[str]) -> Column:
    """The same as a column: one rlike for all globs."""
    found = [f"(?:{r})" for g in globs if (r := to_regex(g))]
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike("(?s)" + "|".join(found)), F.lit(False)) if found else F.lit(False)


def parse_ignore(text: str) -> list[tuple[str, bool]]:
    """(glob, whether it ignores) of each rule of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        again = rule.startswith("!")
        rule = rule[1:].strip() if again else rule
        if rule:
            out.append((rule, not again))
    return out


def path_ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last rule that covers a path decides."""
    return next((ignores for glob, ignores in reversed(rules) if matches(path, [glob])), False)


def ignore_column(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The same as a column: a CASE over the rules, last first."""
    out = None
    for glob, ignores in reversed(rules):
        hit = covers(path, [glob])
        out = F.when(hit, F.lit(ignores)) if out is None else out.when(hit, F.lit(ignores))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))
