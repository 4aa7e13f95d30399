"""Secrets in configuration files: JSON with comments, YAML, TOML, dotenv and XML.

Each format is read into leaves (key, path, decoded value, byte span); one classifier of keys and one of
values then decide which leaves are secrets.
"""

from __future__ import annotations

import functools
import json
import re
import tomllib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.parsers import expat

import regex

from lodesift.functions import values
from lodesift.operators.contextual import LEAST_ENTROPY, is_variable_name, reads_like_words
from lodesift.operators.detectors import Detector, Match

try:
    import yaml
except ImportError:  # without it YAML isn't recognized; the other formats are
    yaml = None

#: Limits on what is taken from one chunk.
TOKENS, DEPTH, STRING_BYTES, MOST_FINDINGS = 200_000, 64, 256 * 1024, 1024
SHORTEST = 4


class Leaf(NamedTuple):
    key: str
    path: tuple[str, ...]
    value: str
    start: int
    end: int


# Keys and values

#: Names of fields that hold credentials, as words of an identifier.
SECRET_NAMES = frozenset("password passwd passphrase secret token clientsecret secrettoken accesstoken refreshtoken authtoken bearertoken signingsecret webhooksecret consumersecret appsecret applicationsecret mastersecret masterkey encryptionkey privatekey".split())
SECRET_LAST = frozenset(("password", "passwd", "passphrase", "secret"))
SECRET_LAST_TWO = frozenset("secrettoken accesstoken refreshtoken authtoken bearertoken masterkey encryptionkey privatekey".split())
#: What such fields hold when they hold no credential.
NO_SECRETS = frozenset(
    "password pass secret string redacted masked changeme change-me change_me dummy example sample notset not-set none null default test dev local true false yes no on off "
    "your-secret your_secret your-password your_password your_key_here your-key-here replace_me todo fixme placeholder example-secret".split()
)
REFERENCES = (
    "env:", "secret://", "vault://", "kv://", "keyvault://", "aws-secretsmanager://", "gcp-secretmanager://", "op://", "1password://", "@microsoft.keyvault(",
    "os.getenv(", "os.environ[", "process.env.", "environment.getenvironmentvariable(", "system.getenv(", "config.get(",
)
FILES = ("/", "./", "../", "~/", "\\\\", "file:", "secrets/", ".secrets/", "certs/", "certificates/", "run/secrets/", "var/run/secrets/")
KEY_FILES = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".crt", ".cer")
KEY_MATERIAL, KEY_STORES = ("privatekey", "masterkey", "encryptionkey"), ("pkcs11:", "arn:aws:kms:", "alias/")

#: Where an identifier falls into words: at what is neither letter nor digit, and before a capital that starts a word.
_WORD_EDGE = regex.compile(r"[\W_]+|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")


@functools.lru_cache(4096)
def key_words(name: str) -> tuple[str, ...]:
    return tuple(word.lower() for word in _WORD_EDGE.split(name) if word)


def is_secret_key(name: str) -> bool:
    """Whether a field of this name holds a credential: by all its words, its last one or its last two."""
    words = key_words(name)
    ends = {"".join(words[-n:]) for n in (1, 2) if n <= len(words)}
    return "".join(words) in SECRET_NAMES or bool(ends & SECRET_LAST_TWO and len(words) > 1) or bool(words) and words[-1] in SECRET_LAST


_CLASSES = regex.compile(r"(?P<letter>\p{L})|(?P<digit>\p{Nd})|(?P<space>\s)|(?P<symbol>.)", regex.S)


class Shape(NamedTuple):
    """What the rules look at in a value."""

    key: str
    text: str
    low: str
    data: bytes
    letters: int
    digits: int
    spaces: int
    symbols: int


def shape_of(key: str, value: str) -> Shape:
    text = value.strip()
    seen = Counter(m.lastgroup for m in _CLASSES.finditer(text[:STRING_BYTES]))
    return Shape(key, text, text.lower(), text.encode("utf-8", "surrogatepass"), seen["letter"], seen["digit"], seen["space"], seen["symbol"])


_VERSION = regex.compile(r"[vV^~<>= ]*(?:[\p{Nd}xX*]+\.)+[\p{Nd}xX*]+(?:[-+].*)?", regex.S)
_NAMED = regex.compile(r"\$[\w:]+|<[\w -]+>|\*[\w-]+|\$\{.*\}|\{\{.*\}\}|%.*%|\$\(.*\)", regex.S)
_ON_DRIVE, _WITH_FOLDER = re.compile(r"[a-z]:[/\\]"), re.compile(r"[/\\]")

#: Each rule tells one kind of value that is no credential, though a field's name says so.
NO_CREDENTIAL: dict[str, Callable[[Shape], object]] = {
    "too short or too long": lambda v: not SHORTEST <= len(v.data) <= STRING_BYTES,
    "a filler": lambda v: v.low in NO_SECRETS,
    "one byte all over": lambda v: len(set(v.data)) < 2,
    "the name of a variable": lambda v: is_variable_name(v.data),
    "a version": lambda v: _VERSION.fullmatch(v.text),
    "a reference": lambda v: _NAMED.fullmatch(v.text) or v.low.startswith(REFERENCES),
    "a file": lambda v: v.low.startswith(FILES) or _ON_DRIVE.match(v.low) or (v.low.endswith(KEY_FILES) and _WITH_FOLDER.search(v.low)),
    "a key that is kept elsewhere": lambda v: v.low.startswith(KEY_STORES) and "".join(key_words(v.key)) in KEY_MATERIAL,
    "prose": lambda v: v.spaces and not v.digits + v.symbols,
    "little variety": lambda v: len(v.data) >= 8 and values.entropy(v.data) < 2.5,
    "a plain word": lambda v: v.letters >= 8 and not v.digits + v.symbols and reads_like_words(v.data),
}


def is_secret_value(key: str, value: str) -> bool:
    shape = shape_of(key, value)
    return not any(rule(shape) for rule in NO_CREDENTIAL.values())


def shown_path(path: tuple[str, ...]) -> str:
    """A dotted path; parts that may themselves be secrets or can't be shown are replaced."""
    out = ""
    for i, part in enumerate(path):
        if part.startswith("["):
            out += part
            continue
        dynamic = not part or len(part.encode("utf-8", "surrogatepass")) > 128 or not part.replace(" ", "x").isprintable() or (len(part) >= 20 and values.entropy(part.encode("utf-8", "surrogatepass")) >= LEAST_ENTROPY)
        out += ("." if i else "") + ("<dynamic-key>" if dynamic else part)
    return out


# JSON

_JSON = re.compile(rb'(?P<skip>[ \t\r\n]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[{}\[\]:,])|(?P<other>"(?:[^"\\]|\\.)*\\?\Z|[^ \t\r\n/":,{}\[\]]+|/)', re.S)


def _decoded(raw: bytes) -> str | None:
    if len(raw) > STRING_BYTES + 2:
        return None
    try:
        found = json.loads(raw.decode())
        found.encode()
        return found
    except ValueError:
        return None


def json_leaves(data: bytes) -> Iterator[Leaf]:
    """String members of objects, wherever they stand in what needs not be valid as a whole."""
    path: list[list] = []  # of each open object or array: [its own path, key or None, index or None]
    before: list[tuple[str, str]] = []
    for n, m in enumerate(_JSON.finditer(data)):
        if m.lastgroup == "skip":
            continue
        kind, word = m.lastgroup, ""
        if kind == "text":
            decoded = _decoded(m[0])
            kind, word = ("other", "") if decoded is None else ("text", decoded)
        elif kind == "mark":
            kind = m[0].decode()
        if kind in "{[":
            own = _child(path)
            path.append([own, None, 0 if kind == "[" else None])
        elif kind in "}]":
            if path:
                path.pop()
        elif kind == ",":
            if path and path[-1][2] is not None:
                path[-1][2] += 1
            elif path:
                path[-1][1] = None
        elif kind == ":" and path and path[-1][2] is None and before and before[-1][0] == "text":
            path[-1][1] = before[-1][1]
        if kind == "text" and len(before) == 2 and before[0][0] == "text" and before[1][0] == ":" and len(path) <= DEPTH:
            where = _child(path) if n < TOKENS else ()
            yield Leaf(before[0][1], where or (before[0][1],), word, m.start() + 1, m.end() - 1)
        before = [*before[-1:], (kind, word)]


def _child(path: list[list]) -> tuple[str, ...]:
    if not path:
        return ()
    own, key, index = path[-1]
    return (*own, f"[{index}]") if index is not None else (*own, key) if key is not None else own


# Lines: dotenv, TOML, YAML


def _is_plain_key(text: str) -> bool:
    return bool(text) and all(c.isalpha() or c.isdigit() or c in "_-." for c in text)


def _lines(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    for line in data.split(b"\n"):
        yield at, line
        at += len(line) + 1


def toml_section(line: bytes) -> list[str] | None:
    text = line.split(b"#")[0].strip().decode("utf-8", "replace")
    if len(text) < 3 or text[0] != "[" or text[-1] != "]" or text[1] == "[":
        return None
    parts = [p.strip() for p in text[1:-1].strip().split(".")]
    return parts if all(map(_is_plain_key, parts)) else None


def _quoted(value: bytes, kind: str) -> tuple[str, int, int] | None:
    """A quoted scalar at the start of value: decoded, and the span between the quotes."""
    quote = value[:1]
    pattern = rb"'((?:[^']|'')*)'" if quote == b"'" and kind == "yaml" else rb"'([^']*)'" if quote == b"'" else rb'"((?:[^"\\]|\\.)*)"'
    m = re.match(pattern, value, re.S)
    if not m or (rest := value[m.end() :].strip()) and not rest.startswith(b"#"):
        return None
    raw = m[1].decode("utf-8", "replace")
    if quote == b"'":
        return raw.replace("''", "'") if kind == "yaml" else raw, m.start(1), m.end(1)
    try:
        if kind == "yaml":
            found = yaml.safe_load(m[0].decode())
        elif kind == "toml":
            found = tomllib.loads("value = " + m[0].decode())["value"]
        else:
            found = _unquoted(raw)
    except Exception:  # a scalar that its format can't decode is no leaf
        return None
    return (found, m.start(1), m.end(1)) if isinstance(found, str) else None


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"'}


def _unquoted(raw: str) -> str:
    def one(m: re.Match[str]) -> str:
        c = m[1]
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if len(c) == 3:
            return chr(int(c, 8))
        raise ValueError(c)

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{3}|.)", one, raw, flags=re.S)


def _scalar(value: bytes, kind: str) -> tuple[str, int, int] | None:
    """A scalar after the sign of assignment: decoded, and its span in value."""
    lead = len(value) - len(value.lstrip(b" \t"))
    body = value[lead:]
    if not body or body[:1] in b"|>[{":
        return None
    if kind == "yaml" and body[:1] == b"&":
        m = re.match(rb"&[^ \t]+(?=[ \t])", body)
        found = _scalar(body[m.end() :], kind) if m else None
        return found and (found[0], found[1] + lead + m.end(), found[2] + lead + m.end())
    if body[:1] in b"'\"":
        found = _quoted(body, kind)
        return found and (found[0], found[1] + lead, found[2] + lead)
    plain = re.split(rb"(?<=[ \t])#", body[1:], maxsplit=1)[0]
    plain = (body[:1] + plain).rstrip(b" \t\r")
    if not plain or len(plain) > STRING_BYTES or kind == "toml":
        return None
    return plain.decode("utf-8", "replace"), lead, lead + len(plain)


class Assignment(NamedTuple):
    key: str
    above: tuple[str, ...]  # of a dotted key
    indent: int
    scalar: tuple[str, int, int] | None  # None: nothing stands after the sign
    block: bool = False


def assignment(line: bytes, kind: str) -> Assignment | None:
    """The assignment that a line is in a format; spans count from the line's start."""
    body = line.lstrip(b" \t")
    indent = sum(8 if c == 9 else 1 for c in line[: len(line) - len(body)])
    if not body or body[:1] in b"#;" or body.startswith(b"//"):
        return None
    for prefix, of in ((b"- ", "yaml"), (b"export ", "dotenv")):
        if of == kind and body.startswith(prefix):
            body = body[len(prefix) :].lstrip(b" \t")
    sign = body.find(b":" if kind == "yaml" else b"=")
    if sign <= 0:
        return None
    name = body[:sign].strip().decode("utf-8", "replace")
    above: tuple[str, ...] = ()
    if kind == "toml":
        parts = []
        for part in (p.strip() for p in name.split(".")):
            if len(part) > 1 and part[0] in "'\"" and part[-1] == part[0]:
                found = _quoted(part.encode(), "toml")
                part = found[0] if found else ""
            elif not _is_plain_key(part):
                part = ""
            if not part:
                return None
            parts.append(part)
        name, above = parts[-1], tuple(parts[:-1])
    elif not _is_plain_key(name):
        return None
    value = body[sign + 1 :]
    shift = len(line) - len(value)
    bare = value.strip()
    if not bare or (kind == "yaml" and bare[:1] == b"#"):
        return Assignment(name, above, indent, None)
    if kind == "yaml" and bare[:1] in b"|>":
        return Assignment(name, above, indent, ("", 0, 0), True) if re.fullmatch(rb"[|>][-+1-9]*\s*(#.*)?", bare) else None
    found = _scalar(value, kind)
    return found and Assignment(name, above, indent, (found[0], found[1] + shift, found[2] + shift))


_ENV = re.compile(rb"(?:export )?\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)", re.S)


def line_format(data: bytes) -> str | None:
    """Which of the line formats a text is, if it is one beyond doubt."""
    mappings = env = toml = 0
    env_ok = toml_ok = yaml_ok = True
    marker = nested = plausible = False
    parent = -1
    for _, line in _lines(data):
        bare = line.strip()
        if not bare or bare.startswith((b"#", b"//")):
            continue
        if toml_section(bare):
            return "toml"
        if bare == b"---":
            marker = True
            continue
        body = line.lstrip(b" \t")
        indent = sum(8 if c == 9 else 1 for c in line[: len(line) - len(body)])
        name, colon, rest = (body[2:] if body.startswith(b"- ") else body).partition(b":")
        if colon and _is_plain_key(name.strip().decode("utf-8", "replace")):
            mappings, env_ok = mappings + 1, False
            valued = bool(rest.strip()) and rest.strip()[:1] != b"#"
            nested |= 0 <= parent < indent
            parent = -1 if indent <= parent else parent
            parent = parent if valued else indent
            found = assignment(line, "yaml")
            plausible |= bool(found and found.scalar and is_secret_key(found.key) and is_secret_value(found.key, found.scalar[0]))
        elif m := _ENV.fullmatch(bare):
            yaml_ok = False
            if m[2].strip() and re.fullmatch(rb"[A-Z][A-Z0-9_]*", m[1]):
                env += 1
            elif m[2].strip() and b"A" <= m[1][:1] <= b"Z":
                env_ok = False
        else:
            env_ok = yaml_ok = False
        if assignment(line, "toml"):
            toml += 1
        else:
            toml_ok = False
    if ((marker and mappings) or nested or (mappings > 1 and yaml_ok and plausible)) and _is_yaml(data):
        return "yaml"
    if env and env_ok and not mappings:
        return "dotenv"
    return "toml" if toml > 1 and toml_ok and not mappings else None


def _is_yaml(data: bytes) -> bool:
    """Whether all documents of a stream are mappings or sequences."""
    if yaml is None:
        return False
    try:
        kinds = [isinstance(node, (yaml.MappingNode, yaml.SequenceNode)) for node, _ in zip(yaml.compose_all(data.decode(), getattr(yaml, "CSafeLoader", yaml.SafeLoader)), range(129), strict=False)]
    except (yaml.YAMLError, RecursionError, ValueError):
        return False
    return bool(kinds) and len(kinds) <= 128 and all(kinds)


def _block(lines: list[tuple[int, bytes]], i: int, indent: int, folded: bool) -> tuple[tuple[str, int, int] | None, int]:
    """A block scalar from line i on, in absolute places, and the line after it."""
    own = []
    while i < len(lines):
        at, line = lines[i]
        line = line.removesuffix(b"\r")
        lead = line[: len(line) - len(line.lstrip(b" \t"))]
        if b"\t" in lead:
            return None, i
        if line.strip() and len(lead) <= indent:
            break
        own.append((at, line, len(lead)))
        i += 1
    full = [(at, line, n) for at, line, n in own if line.strip()]
    cut = min((n for _, _, n in full), default=0)
    if not full or cut <= indent:
        return None, i
    text, gap = "", True
    for _, line, _ in own:
        if not line.strip():
            text += "\n" if text else ""
            gap = True
            continue
        text += ("" if gap else " " if folded else "\n") + line[cut:].decode("utf-8", "replace")
        gap = False
    first, last = full[0], full[-1]
    return (text, first[0] + cut, last[0] + len(last[1])), i


def line_leaves(data: bytes, kind: str) -> Iterator[Leaf]:
    lines, i = list(_lines(data)), 0
    section: tuple[str, ...] = ()
    parents: list[tuple[int, str]] = []
    while i < len(lines):
        at, line = lines[i]
        i += 1
        line = line.removesuffix(b"\r")
        if kind == "toml" and (named := toml_section(line)):
            section = tuple(named)
            continue
        found = assignment(line, kind)
        if not found:
            continue
        above = section + found.above
        if kind == "yaml":
            while parents and parents[-1][0] >= found.indent:
                parents.pop()
            above = tuple(name for _, name in parents)
            if found.scalar is None:
                parents.append((found.indent, found.key))
                continue
        if found.scalar is None:
            continue
        value, start, end = found.scalar
        if found.block:
            sign = line.partition(b":")[2].strip()
            block, i = _block(lines, i, found.indent, sign[:1] == b">")
            if block is None or len(block[0].encode()) > STRING_BYTES:
                continue
            value, start, end = block
        else:
            start, end = at + start, at + end
        yield Leaf(found.key, (*above, found.key), value, start, end)


# XML

_ATTRIBUTE = re.compile(rb"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def xml_leaves(data: bytes) -> list[Leaf]:
    """Texts of elements without children, and attributes; nothing if the document isn't well-formed."""
    parser = expat.ParserCreate(namespace_separator=None)
    parser.buffer_text = False
    parser.ordered_attributes = True
    out: list[Leaf] = []
    stack: list[dict] = []
    count = 0

    class Full(Exception):
        pass

    def step() -> int:
        nonlocal count
        count += 1
        if count > TOKENS:
            raise Full
        return parser.CurrentByteIndex

    def start(name: str, attributes: list[str]) -> None:
        at = step()
        if len(stack) >= DEPTH:
            raise Full
        local = name.rpartition(":")[2]
        path = (*(stack[-1]["path"] if stack else ()), local)
        if stack:
            stack[-1]["child"] = True
        end = _tag_end(data, at)
        spans = [(m[1].decode("utf-8", "replace").rpartition(":")[2], *m.span(2 if m[2] is not None else 3)) for m in _ATTRIBUTE.finditer(data, at + 1 + len(name.encode()), end)]
        decoded = dict(zip(attributes[::2], attributes[1::2], strict=True))
        by_name = {}
        for (key, a, b), value in zip(spans, decoded.values(), strict=False):
            by_name[key.lower()] = (key, value, a, b)
            out.append(Leaf(key, (*path, f"@{key}"), value, a, b))
        names = [by_name[x][1] for x in ("key", "name") if x in by_name]
        for holder in ("value", "secret"):
            if names and holder in by_name:
                _, value, a, b = by_name[holder]
                out.append(Leaf(names[0], (*path, names[0]), value, a, b))
        stack.append({"name": local, "path": path, "text": "", "start": end, "child": False, "plain": True})

    def words(text: str) -> None:
        step()
        if stack:
            stack[-1]["text"] += text

    def other(*_: object) -> None:
        step()
        if stack:
            stack[-1]["plain"] = False

    def end(_: str) -> None:
        at = step()
        own = stack.pop()
        if own["child"] or not own["plain"]:
            return
        a, b = own["start"], at
        inner = data[a:b].strip()
        if inner.startswith(b"<![CDATA[") and inner.endswith(b"]]>"):
            a, b = data.index(b"<![CDATA[", a) + 9, data.rindex(b"]]>", a, b)
        body = data[a:b]
        a, b = a + len(body) - len(body.lstrip()), b - (len(body) - len(body.rstrip()))
        if a < b:
            out.append(Leaf(own["name"], own["path"], own["text"].strip(), a, b))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, words
    parser.CommentHandler = parser.ProcessingInstructionHandler = other
    try:
        parser.Parse(data, True)
    except Full:
        return out
    except (expat.ExpatError, ValueError):
        return []
    return out


def _tag_end(data: bytes, at: int) -> int:
    m = re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""").match(data, at)
    return m.end() if m else len(data)


# The detector


def leaves(data: bytes) -> tuple[str, list[Leaf]]:
    bare = data.strip()
    if not bare:
        return "", []
    first = bare[:1]
    if first == b"{" or (first == b"[" and toml_section(bare.split(b"\n", 1)[0]) is None):
        return "json", list(json_leaves(data))
    try:
        data.decode()
    except UnicodeDecodeError:
        return "", []
    if first == b"<":
        return "xml", xml_leaves(data)
    kind = line_format(data)
    return (kind, list(line_leaves(data, kind))) if kind else ("", [])


def structured(data: bytes) -> list[Match]:
    shift = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    kind, found = leaves(data[shift:])
    out, seen = [], set()
    for leaf in found:
        if len(out) >= MOST_FINDINGS or leaf.start in seen or not is_secret_key(leaf.key) or not is_secret_value(leaf.key, leaf.value):
            continue
        seen.add(leaf.start)
        span = leaf.start + shift, leaf.end + shift
        raw = data[slice(*span)]
        out.append(Match(raw, values.redact(raw), extra={"key_name": leaf.key, "key_path": shown_path(leaf.path), "config_format": kind}, span=span))
    return out


STRUCTURED = (Detector("structured-config-secret", "high", (), structured, fallback=True),)
