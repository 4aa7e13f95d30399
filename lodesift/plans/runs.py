"""A scan of several sources whose results stay whole when some of them fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodesift.operators import findings, remediation
from lodesift.operators.scan import ScanOptions, scan
from lodesift.sources.targets import without_login

#: What stays of a chunk's source beside its path.
KEPT = ("source_type", "repository", "commit", "author", "email", "date", "branch", "image", "layer", "layer_idx", "channel", "channel_name", "message_user", "message_ts", "thread_ts")


@dataclass
class Run:
    """findings: None if no source could be scanned; chunks: those that were scanned; errors by source."""

    findings: DataFrame | None
    chunks: int = 0
    seconds: float = 0.0
    errors: dict[str, str] = field(default_factory=dict)
    interrupted: bool = False

    def exit_code(self) -> int:
        n = 0 if self.findings is None else self.findings.count()
        return findings.exit_code(n, self.interrupted, bool(self.errors))


def scan_sources(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], folder: str, options: ScanOptions = ScanOptions(), parallel: int = 4, keep_raw: bool = False) -> Run:
    """Each source is a function that makes its chunks. Its findings are written below folder, which all machines must
    reach and which only its owner should read if keep_raw is set, so they are there whatever becomes of the others;
    a source that fails is told by its name and error, without logins. At most parallel sources are scanned at once.
    Chunks that are null aren't counted. Findings are in the total order over all sources.

    An interruption (KeyboardInterrupt) ends the run with what is written by then."""
    run, started = Run(None), time.monotonic()
    done: dict[str, tuple[DataFrame, int]] = {}

    def one(numbered: tuple[int, tuple[str, Callable[[], DataFrame]]]) -> None:
        k, (name, chunks) = numbered
        try:
            read = chunks()
            seen = Observation()
            counted = read.where("data is not null").observe(seen, F.count(F.lit(1)).alias("chunks"))
            kept = [c for c in KEPT if c in read.columns]
            path = f"{folder}/{k}"
            scan(counted, options, keep=kept, keep_raw=keep_raw).withColumn("scanned_source", F.lit(without_login(name))).write.mode("overwrite").parquet(path)
            done[name] = spark.read.parquet(path), seen.get["chunks"]
        except Exception as e:  # a source may fail in any way; the others go on
            run.errors[without_login(name)] = without_login(str(e).splitlines()[0] if str(e) else type(e).__name__)

    pool = ThreadPoolExecutor(max(1, parallel))
    try:
        list(pool.map(one, enumerate(sources.items())))
    except KeyboardInterrupt:
        run.interrupted = True
        spark.sparkContext.cancelAllJobs()
    finally:
        pool.shutdown(cancel_futures=True)
    for name in sources:
        if name in done:
            found, chunks = done[name]
            run.chunks += chunks
            run.findings = found if run.findings is None else run.findings.unionByName(found, allowMissingColumns=True)
    if run.findings is not None:
        run.findings = findings.ordered(run.findings)
    run.seconds = time.monotonic() - started
    return run


def finished(run: Run, severity: str = "", ignore_file: str = "", advice: bool = False, verified_only: bool = False) -> Run:
    """The run with what happens after a scan: the ignore file's rules, the floor, advice."""
    found = run.findings
    if found is not None:
        found = findings.without_ignored(found, ignore_file) if ignore_file else found
        found = findings.at_least(found, severity) if severity else found
        found = findings.only_verified(found) if verified_only else found
        found = findings.ordered(remediation.enriched(found)) if advice else found
    return Run(found, run.chunks, run.seconds, run.errors, run.interrupted)


def told(run: Run, kind: str = "", target: str = "") -> str:
    """Lines about a run for the error stream: where, chunks, findings, time, failures."""
    place = f" {kind}" * bool(kind) + f" {without_login(target)}" * bool(target)
    lines = [f"Scanned{place}: {run.chunks} chunks in {run.seconds:.1f} s" + " (interrupted)" * run.interrupted]
    lines.append(findings.summary(run.findings) if run.findings is not None else "Found 0 secrets.")
    return "\n".join(lines + [f"failed: {name}: {error}" for name, error in sorted(run.errors.items())])
