"""What happens to findings after the scan: filters, order, summaries. All are DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions.columns import severity_rank
from lodesift.functions.globs import ignore_column, parse_ignore
from lodesift.operators.detectors import SEVERITIES

#: The total order of a report.
ORDER = ("file_path", "line", "detector_id", "redacted", "id")
ACTIVE = "verified_active"


def optional(found: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of found, or nulls where it has none of that name."""
    return F.col(f"`{name}`") if name in found.columns else F.lit(None).cast(kind).alias(name)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that are added for a while, none of them a column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings of that severity or a higher one."""
    if severity not in SEVERITIES:
        raise ValueError(f"no severity {severity!r}")
    return found.where(severity_rank(F.col("severity")) >= SEVERITIES.index(severity))


def only_verified(found: DataFrame) -> DataFrame:
    return found.where(optional(found, "status") == ACTIVE)


def without_ignored(found: DataFrame, ignore_file: str) -> DataFrame:
    """Findings whose path the rules of an ignore file don't cover; the last rule that covers one decides."""
    return found.where(~ignore_column(F.coalesce(F.col("file_path"), F.lit("")), parse_ignore(ignore_file)))


def ordered(found: DataFrame) -> DataFrame:
    """The total order, by a range exchange."""
    return found.orderBy(*ORDER)


def severity_counts(found: DataFrame) -> DataFrame:
    """(severity, findings), severities without findings left out."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def summary(found: DataFrame) -> str:
    counts = {r["severity"]: r["findings"] for r in severity_counts(found).collect()}  # four rows at most
    if not counts:
        return "Found 0 secrets."
    return f"Found {sum(counts.values())} secrets ({', '.join(f'{counts[s]} {s}' for s in reversed(SEVERITIES) if s in counts)})."


def rule_index(found: DataFrame) -> DataFrame:
    """(detector_id, severity, rule_index): detectors by their first finding in the total order. The first one of
    each is found by a combined aggregate; only a row for each detector is sorted."""
    first = found.groupBy("detector_id").agg(F.min(F.struct(*ORDER, "severity")).alias("first"))
    rank = F.row_number().over(Window.orderBy(*[f"first.{c}" for c in ORDER])) - 1
    return first.select("detector_id", F.col("first.severity").alias("severity"), rank.alias("rule_index"))


def exit_code(findings: int, interrupted: bool = False, failed: bool = False) -> int:
    """1 with findings, 2 after a failure, 3 if interrupted, else 0; findings come before an interruption."""
    if failed:
        return 2
    return 1 if findings else 3 if interrupted else 0
