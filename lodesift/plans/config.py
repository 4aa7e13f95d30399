"""Settings of a run: what a caller gives goes before the environment, that before a file, that before defaults."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping

from lodesift.operators.detectors import SEVERITIES
from lodesift.operators.paths import LARGEST
from lodesift.sinks.documents import EXTENSIONS

PREFIX = "LODESIFT_"
CEILING = 1 << 30
#: All settings by name, with their defaults.
DEFAULTS: dict[str, object] = {
    "scan.max-file-size": LARGEST,
    "scan.concurrency": 1,
    "detection.entropy.enabled": True,
    "detection.entropy.threshold": 4.0,
    "verification.enabled": True,
    "verification.timeout": "10s",
    "verification.concurrency": 4,
    "verification.rate-limit": 10.0,
    "filter.exclude-paths": [],
    "filter.exclude-detectors": [],
    "output.format": "json",
    "output.file": "",
    "output.severity-threshold": "",
    "output.show-raw": False,
    "custom-rules": [],
}
#: A caller's lists are added to what other places say.
ADDED = ("filter.exclude-paths", "filter.exclude-detectors")
_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: object) -> float:
    """A duration such as 1m30s; a bare number counts nanoseconds."""
    if isinstance(text, int | float) and not isinstance(text, bool):
        return text * 1e-9
    parts = re.findall(r"([0-9.]+)(ns|us|ms|s|m|h)", str(text))
    if not parts or "".join(n + u for n, u in parts) != str(text):
        raise ValueError(f"no duration {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def parsed(content: str, path: str = "") -> dict[str, object]:
    """The settings of a file by name; JSON, or YAML where its parser is installed. A malformed file is an error."""
    try:
        if path.endswith(".json"):
            tree = json.loads(content or "{}")
        else:
            import yaml

            tree = yaml.safe_load(content) or {}
    except ModuleNotFoundError:
        raise
    except Exception as e:
        raise ValueError(f"malformed settings in {path or 'the text'}: {e}") from None
    if not isinstance(tree, dict):
        raise ValueError(f"no settings in {path or 'the text'}")
    out: dict[str, object] = {}

    def walk(node: Mapping, name: str) -> None:
        for key, value in node.items():
            at = f"{name}.{key}" if name else str(key)
            if isinstance(value, Mapping) and at not in DEFAULTS:
                walk(value, at)
            elif at in DEFAULTS:
                out[at] = value

    walk(tree, "")
    return out


def from_file(path: str) -> dict[str, object]:
    """Nothing for a file that isn't there; other failures are errors."""
    try:
        with open(path, encoding="utf-8") as f:
            return parsed(f.read(), path)
    except FileNotFoundError:
        return {}


def _typed(name: str, value: object) -> object:
    """The value with the type of the setting's default."""
    default = DEFAULTS[name]
    try:
        if isinstance(default, bool):
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}[str(value).lower()]
        if isinstance(default, int):
            return int(value)
        if isinstance(default, float):
            return float(value)
    except (KeyError, TypeError, ValueError):
        raise ValueError(f"{name}: {value!r} isn't a {type(default).__name__}") from None
    if isinstance(default, list):
        return [x for x in re.split(r"[,\s]+", value) if x] if isinstance(value, str) else list(value or [])
    return "" if value is None else value


def resolve(given: Mapping[str, object] = {}, environment: Mapping[str, str] = os.environ, file: Mapping[str, object] = {}) -> dict[str, object]:
    """All settings, checked. given holds what the caller set; names are those of DEFAULTS."""
    if unknown := sorted(given.keys() - DEFAULTS.keys()):
        raise ValueError(f"no settings {', '.join(unknown)}")
    out = {}
    for name, default in DEFAULTS.items():
        variable = PREFIX + name.upper().replace(".", "_").replace("-", "_")
        value = environment[variable] if variable in environment and name != "custom-rules" else file.get(name, default)
        value = _typed(name, value)
        if name in given:
            own = _typed(name, given[name])
            value = merged(value, own) if name in ADDED else own
        out[name] = value
    check(out)
    return out


def merged(settled: Iterable[str], added: Iterable[str]) -> list[str]:
    return [*settled, *added]


def check(settings: Mapping[str, object]) -> None:
    """An error for the first setting that's out of its range; those of verification count only if it is on."""
    s = settings
    wrong = {
        "scan.concurrency": s["scan.concurrency"] < 1,
        "scan.max-file-size": not 1 <= s["scan.max-file-size"] <= CEILING,
        "output.format": s["output.format"] not in EXTENSIONS,
        "detection.entropy.threshold": not 0 <= s["detection.entropy.threshold"] <= 8,
        "output.severity-threshold": s["output.severity-threshold"] not in ("", *SEVERITIES),
    }
    if s["verification.enabled"]:
        wrong |= {"verification.timeout": seconds(s["verification.timeout"]) < 0.001, "verification.concurrency": s["verification.concurrency"] < 1, "verification.rate-limit": not s["verification.rate-limit"] > 0}
    for name, bad in wrong.items():
        if bad:
            raise ValueError(f"{name}: {s[name]!r} is out of range")
