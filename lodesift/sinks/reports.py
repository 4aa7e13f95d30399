"""Reports as columns of text, so that any number of findings is written by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.columns import csv_cell, escape_command
from lodesift.operators.findings import optional, rule_index

TOOL = "lodesift"
CSV_COLUMNS = ("id", "detector_id", "severity", "redacted", "source", "file_path", "line", "commit", "verification_status", "remediation")


def level(severity: Column, least: str) -> Column:
    return F.when(severity == "critical", "error").when(severity == "high", "warning").otherwise(least)


def csv_rows(found: DataFrame) -> DataFrame:
    """The columns of a CSV report; source is the repository, image or channel. No cell starts a formula."""
    label = F.coalesce(*[F.nullif(optional(found, c), F.lit("")) for c in ("repository", "image", "channel_name", "channel")], F.lit(""))
    cells = {
        "source": label,
        "line": F.when(F.col("line") > 0, F.col("line").cast("string")),
        "verification_status": F.coalesce(optional(found, "status"), F.lit("unverified")),
        "remediation": optional(found, "remediation_title"),
    }
    return found.select(*[csv_cell(F.coalesce(cells.get(c, optional(found, c)).cast("string"), F.lit(""))).alias(c) for c in CSV_COLUMNS])


def annotations(found: DataFrame) -> DataFrame:
    """(command): a workflow command for each finding, with redacted values only."""
    status = F.coalesce(optional(found, "status"), F.lit("unverified"))
    told = F.when(status == "verified_active", "; its provider accepts it, so revoke it now").when(status == "verified_inactive", "; its provider no longer accepts it").otherwise("")
    shown = F.when(F.length("redacted") > 0, F.concat(F.lit(" "), F.col("redacted"))).otherwise("")
    message = F.concat(F.col("severity"), F.lit(" finding"), shown, F.lit(" of "), F.col("detector_id"), told)
    line = F.when(F.col("line") > 0, F.concat(F.lit(",line="), F.col("line").cast("string"))).otherwise("")
    place = F.when(F.length("file_path") > 0, F.concat(F.lit("file="), escape_command(F.col("file_path"), True), line, F.lit(","))).otherwise("")
    how = F.when(status == "verified_active", "error").otherwise(level(F.col("severity"), "notice"))
    title = escape_command(F.concat(F.lit(f"{TOOL}: "), F.col("detector_id")), True)
    return found.select(F.concat(F.lit("::"), how, F.lit(" "), place, F.lit("title="), title, F.lit("::"), escape_command(message)).alias("command"))


def artifact_uri(found: DataFrame) -> Column:
    """The path, or for a chat message an address made of its channel and time; null for findings without a place."""
    bare = lambda c: F.nullif(F.regexp_replace(optional(found, c), "^#", ""), F.lit(""))
    message = F.concat(F.lit("slack://"), F.coalesce(bare("channel_name"), bare("channel"), F.lit("unknown")), F.lit("/"), F.coalesce(F.nullif(optional(found, "message_ts"), F.lit("")), F.lit("unknown")))
    return F.coalesce(F.nullif(optional(found, "file_path"), F.lit("")), F.when(optional(found, "source_type") == "slack", message))


def sarif_columns(found: DataFrame) -> list[Column]:
    """(rule_id, level, message, fingerprint, uri, start_line). The fingerprint doesn't tell the line, so that it stays
    when the value moves within its file."""
    print_of = F.substring(F.sha2(F.concat(F.col("detector_id"), F.lit("\x00"), F.col("redacted"), F.lit("\x00"), F.coalesce("file_path", F.lit(""))), 256), 1, 32)
    return [
        F.col("detector_id").alias("rule_id"), level(F.col("severity"), "note").alias("level"), F.concat(F.col("detector_id"), F.lit(" matches "), F.col("redacted")).alias("message"),
        print_of.alias("fingerprint"), artifact_uri(found).alias("uri"), F.when(F.col("line") > 0, F.col("line")).alias("start_line"),
    ]


def sarif_results(found: DataFrame) -> DataFrame:
    """sarif_columns and rule_index of each finding. Rules are a row for each detector."""
    found = found.persist()  # read twice below; it holds no values
    rules = F.broadcast(rule_index(found).select(F.col("detector_id").alias("rule_id"), "rule_index"))
    return found.select(*sarif_columns(found)).join(rules, "rule_id")


def json_rows(found: DataFrame, show_raw: bool = False) -> DataFrame:
    """(value): a JSON object for each finding. Values, and what detectors tell of them, only with show_raw."""
    sources = [c for c in ("source_type", "repository", "commit", "author", "email", "date", "branch", "file_path", "line", "image", "layer", "layer_idx", "channel", "channel_name", "message_user", "message_ts", "thread_ts") if c in found.columns]
    source = F.struct(*[F.when(F.col(c) > 0, F.col(c)).alias(c) if c == "line" else F.nullif(F.col(c), F.lit("")).alias(c) if dict(found.dtypes)[c] == "string" else F.col(c) for c in sources])
    verification = F.struct(F.coalesce(optional(found, "status"), F.lit("unverified")).alias("status"))
    advised = [F.when(F.col("remediation_title").isNotNull(), F.struct(*[F.col(f"remediation_{c}").alias(c) for c in ("title", "steps", "urgency", "checklist")])).alias("remediation")] if "remediation_steps" in found.columns else []
    raw = [F.col("raw").cast("string").alias("raw"), optional(found, "extra", "map<string,string>").alias("extra_data")] if show_raw and "raw" in found.columns else []
    return found.select(F.to_json(F.struct("id", "detector_id", "severity", "redacted", source.alias("source"), verification.alias("verification"), "entropy", *advised, *raw)).alias("value"))


def write(found: DataFrame, path: str, kind: str = "json") -> None:
    """A report in a folder, a file for each partition: json (an object a line), csv, or github."""
    if kind == "json":
        json_rows(found).write.text(path)
    elif kind == "csv":
        csv_rows(found).write.option("header", True).option("escape", '"').csv(path)
    elif kind == "github":
        annotations(found).write.text(path)
    else:
        raise ValueError(f"no report {kind!r}")
