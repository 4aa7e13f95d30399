"""All built-in detectors by id, and detectors made from the user's rules."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

import regex as re

from lodesift.functions import values
from lodesift.operators.contextual import CONTEXTUAL
from lodesift.operators.detectors import SEVERITIES, STRUCTURAL, Detector, Match
from lodesift.operators.structured import STRUCTURED

LONGEST_RULE = 4096
RULE_SECONDS = 60


def _register(found: Iterable[Detector]) -> dict[str, Detector]:
    out: dict[str, Detector] = {}
    for detector in found:
        if detector.id in out:
            raise ValueError(f"two detectors are named {detector.id}")
        out[detector.id] = detector
    return dict(sorted(out.items()))


BUILT_IN = _register([*STRUCTURAL, *CONTEXTUAL, *STRUCTURED])


#: What patterns of automata can't have, and ours therefore neither: looking around, references, atoms.
_FORBIDDEN = re.compile(r"\(\?(?:[=!>#|&]|<[=!]|P=|P>|R|[0-9])|\\[1-9]|\\k|\\G")
_QUANTIFIER = re.compile(r"(?:^|[^\\])(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\Z")
_RULE_TOKEN = re.compile(r"""(?P<quoted>\\Q(?P<literal>.*?)(?:\\E|\Z))|(?P<code>\\x\{(?P<hex>[0-9A-Fa-f]{1,6})\})|(?P<unicode>\\[pP](?:\{[^}]*\}|.))
    |(?P<escape>\\.)|(?P<flags>\(\?[a-zA-Z-]+[:)])|(?P<posix>\[:\^?[a-z]+:\])|(?P<other>.)""", re.S | re.X)
_SPACES = r"\t\n\f\r\x20"


def translated(rule_text: str) -> str:
    """A pattern of the dialect of linear-time automata in that of the matcher here: \\z and $ are the end of the text, \\s
    has no vertical tab, \\d and \\w are of ASCII, \\x{...} and \\Q...\\E are read. What the dialect doesn't have is an
    error, and so is (?U), which isn't read."""
    if _FORBIDDEN.search(re.sub(r"\\\\", "", rule_text)):
        raise ValueError("the dialect has no look-around, references or atomic groups")
    out, within, lines = [], False, False
    for m in _RULE_TOKEN.finditer(rule_text):
        whole = m[0]
        if m["quoted"] is not None:
            out.append(re.escape(m["literal"]))
        elif m["code"]:
            out.append(re.escape(chr(int(m["hex"], 16)), special_only=False))
        elif m["flags"]:
            if "U" in whole:
                raise ValueError("(?U) isn't read")
            lines = lines or "m" in whole.partition("-")[0]
            out.append(whole)
        elif m["escape"]:
            spaces = {r"\s": _SPACES if within else f"[{_SPACES}]", r"\S": rf"[^{_SPACES}]", r"\z": r"\Z", r"\d": "0-9" if within else "[0-9]", r"\w": "0-9A-Za-z_" if within else "[0-9A-Za-z_]"}
            if within and whole in (r"\S", r"\D", r"\W"):
                raise ValueError(f"{whole} in a class isn't read")
            out.append(spaces.get(whole, {r"\D": "[^0-9]", r"\W": "[^0-9A-Za-z_]", r"\b": r"(?a:\b)", r"\B": r"(?a:\B)"}.get(whole, whole)))
        elif whole == "+" and not within and _QUANTIFIER.search("".join(out)):
            raise ValueError("the dialect has no possessive quantifiers")
        elif whole == "$" and not within:
            out.append("$" if lines else r"\Z")
        else:
            within = whole == "[" or (within and whole != "]") if m["other"] else within
            out.append(whole)
    return "".join(out)


def custom(rule: Mapping[str, object]) -> Detector:
    """rule: id, regex, severity, and if wanted keywords, description and an entropy floor of its own. Every whole
    match is a finding. The regex is of the dialect that translated() reads and is matched against characters; one
    that takes more than RULE_SECONDS on a chunk is an error."""
    id, rule_text, severity = str(rule.get("id") or ""), str(rule.get("regex") or ""), str(rule.get("severity") or "medium").lower()
    if not id or not rule_text:
        raise ValueError("a rule needs an id and a regex")
    if len(rule_text) > LONGEST_RULE:
        raise ValueError(f"{id}: the regex has more than {LONGEST_RULE} characters")
    if severity not in SEVERITIES:
        raise ValueError(f"{id}: no severity {severity!r}")
    try:
        pattern = re.compile(translated(rule_text))
    except (re.error, ValueError) as e:
        raise ValueError(f"{id}: {e}") from None
    floor = float(rule.get("entropy") or 0)

    def find(data: bytes) -> list[Match]:
        out = []
        for m in pattern.finditer(data.decode("utf-8", "surrogateescape"), timeout=RULE_SECONDS):
            raw = m[0].encode("utf-8", "surrogateescape")
            if raw and (not floor or values.entropy(raw) >= floor):
                out.append(Match(raw, values.redact(raw)))
        return out

    return Detector(id, severity, tuple(map(str, rule.get("keywords") or ())), find, pattern=rule_text)


def select(rules: Iterable[Mapping[str, object]] = (), exclude: Iterable[str] = (), only: Iterable[str] | None = None) -> list[Detector]:
    """The detectors of a run, by id. Rules that are malformed or take an id that exists are left out with a
    warning; a run without any detector is an error."""
    found = dict(BUILT_IN)
    for rule in rules:
        try:
            made = custom(rule)
            if made.id in found:
                raise ValueError(f"{made.id}: there is a detector of that id")
            found[made.id] = made
        except ValueError as e:
            warnings.warn(f"rule left out: {e}", stacklevel=2)
    dropped = set(exclude)
    out = [d for id, d in sorted(found.items()) if id not in dropped and (only is None or id in set(only))]
    if not out:
        raise ValueError("no detector is left")
    return out
