"""python -m lodesift PATH...: scans files below folders and reports what is found."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from pyspark.sql import SparkSession

from lodesift.operators.scan import ScanOptions
from lodesift.plans import config, runs
from lodesift.sinks import documents
from lodesift.sources import files


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodesift", description=__doc__)
    out.add_argument("paths", nargs="+", help="folders, files or addresses of a store")
    out.add_argument("--config", default=".lodesift.yaml", help="settings; a file that isn't there has none")
    out.add_argument("--ignore-file", default=".lodesiftignore")
    out.add_argument("--format", choices=sorted(documents.EXTENSIONS))
    out.add_argument("--output")
    out.add_argument("--min-severity")
    out.add_argument("--max-file-size", type=int)
    out.add_argument("--concurrency", type=int)
    out.add_argument("--exclude", action="append", help="a glob of paths to leave out; may be repeated")
    out.add_argument("--exclude-detectors", action="append")
    out.add_argument("--show-raw", action="store_true", default=None)
    out.add_argument("--remediation", action="store_true")
    return out


#: Options of the command line by the setting that they give.
GIVEN = {"output.format": "format", "output.file": "output", "output.severity-threshold": "min_severity", "scan.max-file-size": "max_file_size", "scan.concurrency": "concurrency", "filter.exclude-paths": "exclude", "filter.exclude-detectors": "exclude_detectors", "output.show-raw": "show_raw"}


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        settings = config.resolve({s: getattr(args, a) for s, a in GIVEN.items() if getattr(args, a) is not None}, file=config.from_file(args.config))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    ignore = ""
    if os.path.isfile(args.ignore_file):
        with open(args.ignore_file, encoding="utf-8") as f:
            ignore = f.read()
    spark = SparkSession.builder.appName("lodesift").getOrCreate()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        print("spark.checkpoint.dir must name a folder that all machines reach", file=sys.stderr)
        return 2
    options = ScanOptions(rules=tuple(settings["custom-rules"]), exclude=tuple(settings["filter.exclude-detectors"]), entropy=settings["detection.entropy.enabled"], threshold=settings["detection.entropy.threshold"])
    read = lambda path: lambda: files.files(spark, path, globs=settings["filter.exclude-paths"], largest=settings["scan.max-file-size"])
    with tempfile.TemporaryDirectory(prefix="lodesift-") as own:
        folder = f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/findings" if shared else f"file://{own}"
        run = runs.scan_sources(spark, {p: read(p) for p in args.paths}, folder, options, settings["scan.concurrency"], settings["output.show-raw"])
        run = runs.finished(run, settings["output.severity-threshold"], ignore, args.remediation)
        if run.findings is not None:
            documents.report(run.findings, settings["output.file"], settings["output.format"], settings["output.show-raw"])
        print(runs.told(run, "filesystem", " ".join(args.paths)), file=sys.stderr)
        return run.exit_code()


if __name__ == "__main__":
    sys.exit(main())
