"""Reports that are one document by their format: a JSON array, a SARIF log, an aligned table.

Findings are read in the total order, partition after partition, and written as they come, so the driver holds one
partition at a time. A report of unbounded size belongs in lodesift.sinks.reports, which all tasks write."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodesift.functions.columns import displayable
from lodesift.operators.findings import free_names, optional, ordered, rule_index, summary
from lodesift.sinks import reports

EXTENSIONS = {"json": ".json", "sarif": ".sarif", "csv": ".csv", "table": ".txt", "github": ".txt"}
#: Fixed values of the format.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
COLOURS = {"critical": "\x1b[1;31m", "high": "\x1b[31m", "medium": "\x1b[33m", "low": "\x1b[34m"}
PLAIN = "\x1b[0m"
HEADERS = ("SEVERITY", "DETECTOR", "FILE", "LINE", "REDACTED", "STATUS", "REMEDIATION")


def _array(out: TextIO, items: Iterator[str], indent: str = "") -> None:
    """A JSON array of texts that are JSON, one a line."""
    first = True
    out.write("[")
    for item in items:
        out.write(("\n" if first else ",\n") + indent + "  " + item)
        first = False
    out.write("]" if first else f"\n{indent}]")


def write_json(found: DataFrame, out: TextIO, show_raw: bool = False) -> None:
    """One array of findings; values only with show_raw, if found has them."""
    _array(out, (r["value"] for r in reports.json_rows(ordered(found), show_raw).toLocalIterator()))
    out.write("\n")


def write_sarif(found: DataFrame, out: TextIO, version: str = "0", show_raw: bool = False) -> None:
    """A SARIF log with one run. Rules come by their first finding, results in the total order."""
    rules = []
    helps = found.select("detector_id", optional(found, "remediation_steps", "array<string>").alias("steps")).where("steps is not null").groupBy("detector_id").agg(F.first("steps").alias("steps"))
    told = {r["detector_id"]: r["steps"] for r in helps.collect()}  # a row for each detector
    for r in rule_index(found).orderBy("rule_index").collect():  # likewise
        rule = {"id": r["detector_id"], "shortDescription": {"text": f"Finds {r['detector_id']} in text"}, "defaultConfiguration": {"level": {"critical": "error", "high": "warning"}.get(r["severity"], "note")}}
        if told.get(r["detector_id"]):
            rule["help"] = {"text": "\n".join(told[r["detector_id"]])}
        rules.append(rule)
    place = {r["id"]: i for i, r in enumerate(rules)}

    def result(r: Row) -> str:
        out = {"ruleId": r["rule_id"], "ruleIndex": place[r["rule_id"]], "level": r["level"], "message": {"text": r["message"]}, "partialFingerprints": {"lodesift/v1": r["fingerprint"]}}
        if r["uri"]:
            where = {"artifactLocation": {"uri": r["uri"]}} | ({"region": {"startLine": r["start_line"]}} if r["start_line"] else {})
            out["locations"] = [{"physicalLocation": where}]
        if show_raw and r["raw"]:
            out["properties"] = {"raw": bytes(r["raw"]).decode("utf-8", "replace")}
        return json.dumps(out, ensure_ascii=False)

    driver = {"name": reports.TOOL, "version": version, "rules": rules}
    out.write(f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {json.dumps({"driver": driver}, ensure_ascii=False)}, "results": ')
    ordered_found = ordered(found)
    told_of = ordered_found.select(*reports.sarif_columns(ordered_found), optional(ordered_found, "raw", "binary").alias("raw"))
    _array(out, map(result, told_of.toLocalIterator()), "  ")
    out.write("}]}\n")


def width(text: str) -> int:
    """Cells of a terminal: wide characters take two, marks that join others none."""
    joined = lambda c: unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf")
    return sum(0 if joined(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def write_table(found: DataFrame, out: TextIO, colour: bool = False, show_raw: bool = False) -> None:
    """Columns aligned by the cells of a terminal, and a line of counts. Findings are read twice: for the widths,
    then to be written; persist them if the scan is dear."""
    shown = lambda c: displayable(F.coalesce(optional(found, c).cast("string"), F.lit("")))
    cells = [F.upper("severity"), shown("detector_id"), shown("file_path"), F.when(F.col("line") > 0, F.col("line").cast("string")).otherwise("-"), shown("redacted"), F.coalesce(optional(found, "status"), F.lit("unverified")), F.coalesce(F.nullif(shown("remediation_title"), F.lit("")), F.lit("-"))]
    headers = HEADERS
    if show_raw and "raw" in found.columns:
        cells, headers = [*cells, F.to_json(F.struct(F.col("raw").cast("string").alias("raw")))], (*HEADERS, "RAW")
    (name,) = free_names(found, "cells")
    lines = ordered(found.withColumn(name, F.array(*cells))).select(name)
    widths = [len(h) for h in headers]
    for (row,) in lines.toLocalIterator():
        widths = [max(w, width(c)) for w, c in zip(widths, row, strict=True)]

    def line(row: list[str], painted: str | None = None) -> None:
        gaps = [c + " " * (w - width(c)) for c, w in zip(row, widths, strict=True)]
        if painted:
            gaps[0] = gaps[0].replace(row[0], painted, 1)
        out.write("  ".join([*gaps[:-1], row[-1]]) + "\n")

    line(list(headers))
    line(["-" * w for w in widths])
    for (row,) in lines.toLocalIterator():
        line(row, f"{COLOURS[row[0].lower()]}{row[0]}{PLAIN}" if colour else None)
    told = summary(found)
    if colour:
        told = re.sub(r"\d+ (critical|high|medium|low)", lambda m: COLOURS[m[1]] + m[0] + PLAIN, told)
    out.write(f"\n{told}\n")


def write_lines(rows: DataFrame, out: TextIO, header: str = "") -> None:
    out.write(header)
    for (value,) in rows.toLocalIterator():
        out.write(value + "\n")


def write(found: DataFrame, out: TextIO, kind: str = "json", show_raw: bool = False, colour: bool = False) -> None:
    if kind == "json":
        write_json(found, out, show_raw)
    elif kind == "sarif":
        write_sarif(found, out, show_raw=show_raw)
    elif kind == "table":
        write_table(found, out, colour, show_raw)
    elif kind == "csv":
        cells = reports.csv_rows(ordered(found))
        write_lines(cells.select(F.to_csv(F.struct(*cells.columns), {"escape": '"'})), out, ",".join(reports.CSV_COLUMNS) + "\n")
    elif kind == "github":
        write_lines(reports.annotations(ordered(found)), out)
    else:
        raise ValueError(f"no report {kind!r}")


def target(path: str, kind: str) -> str:
    """Where a report goes: nowhere but to the output stream for workflow commands, which only count there; a path
    without an extension gets the format's."""
    if kind == "github" or not path:
        return ""
    return path if os.path.splitext(path)[1] else path + EXTENSIONS[kind]


def report(found: DataFrame, path: str = "", kind: str = "json", show_raw: bool = False) -> str:
    """Writes to a file that only its owner may read, or to the output stream; tells the file's path."""
    if kind not in EXTENSIONS:
        raise ValueError(f"no report {kind!r}")
    path = target(path, kind)
    if not path:
        write(found, sys.stdout, kind, show_raw, kind == "table" and sys.stdout.isatty() and "NO_COLOR" not in os.environ)
        return ""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    with open(fd, "w", encoding="utf-8", newline="") as out:
        write(found, out, kind, show_raw)
    return path
