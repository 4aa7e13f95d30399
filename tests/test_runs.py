import io
import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from lodesift.__main__ import main
from lodesift.operators import remediation
from lodesift.operators.registry import BUILT_IN
from lodesift.operators.scan import ScanOptions, scan
from lodesift.plans import config, runs
from lodesift.sinks import documents, reports
from lodesift.sources import targets

TOKEN = "ghp_" + "aB3dE6gH9jK2" * 3
ONLY = ScanOptions(only=("github-token", "gitlab-pat"))


def _found(spark, *paths, raw=False):
    chunks = spark.createDataFrame([(p, f"x\n{TOKEN}\n") for p in paths], "file_path string, data string")
    return scan(chunks, ONLY, keep_raw=raw)


def _written(found, kind, **more):
    out = io.StringIO()
    documents.write(found, out, kind, **more)
    return out.getvalue()


def test_every_detector_has_advice(spark):
    assert {d for of in remediation.ISSUERS.values() for d in of} == set(BUILT_IN)
    assert sum(map(len, remediation.ISSUERS.values())) == len(BUILT_IN)
    found = remediation.enriched(_found(spark, "a.txt").withColumn("remediation_title", F.lit("old")))
    assert [(r.remediation_title, r.remediation_urgency, len(r.remediation_steps)) for r in found.collect()] == [("Revoke the token at GitHub", "now", 3)]
    own = _found(spark, "a.txt").withColumn("detector_id", F.lit("own-rule"))
    assert remediation.enriched(own).first().remediation_title is None
    assert json.loads(reports.json_rows(found).first().value)["remediation"]["urgency"] == "now"


def test_json_is_one_array(spark):
    got = json.loads(_written(_found(spark, "b.txt", "a.txt"), "json"))
    assert [(x["source"]["file_path"], x["source"]["line"], x["severity"]) for x in got] == [("a.txt", 2, "critical"), ("b.txt", 2, "critical")]
    assert all("raw" not in x for x in got) and TOKEN not in json.dumps(got)
    assert json.loads(_written(_found(spark, "a.txt").limit(0), "json")) == []
    assert json.loads(_written(_found(spark, "a.txt", raw=True), "json", show_raw=True))[0]["raw"] == TOKEN


def test_sarif_is_one_log(spark):
    log = json.loads(_written(remediation.enriched(_found(spark, "b.txt", "a.txt")), "sarif"))
    assert log["version"] == "2.1.0" and TOKEN not in json.dumps(log)
    (run,) = log["runs"]
    assert [(r["id"], r["defaultConfiguration"]["level"], r["help"]["text"].count("\n")) for r in run["tool"]["driver"]["rules"]] == [("github-token", "error", 2)]
    places = [r["locations"][0]["physicalLocation"] for r in run["results"]]
    assert [(p["artifactLocation"]["uri"], p["region"]["startLine"]) for p in places] == [("a.txt", 2), ("b.txt", 2)]
    assert json.loads(_written(_found(spark, "a.txt").limit(0), "sarif"))["runs"][0]["results"] == []


def test_messages_have_an_address(spark):
    found = _found(spark, "").withColumn("source_type", F.lit("slack")).withColumn("channel_name", F.lit("#general")).withColumn("message_ts", F.lit("17.5"))
    assert reports.sarif_results(found).first().uri == "slack://general/17.5"
    assert reports.sarif_results(found.drop("channel_name", "message_ts")).first().uri == "slack://unknown/unknown"


def test_table_is_aligned_by_cells(spark):
    lines = _written(_found(spark, "日本.txt", "a\x1b[2Jb.txt"), "table").splitlines()
    assert lines[0].split() == list(documents.HEADERS)
    starts = {documents.width(x[: x.index(w)]) for x, w in ((lines[0], "STATUS"), (lines[2], "unverified"), (lines[3], "unverified"))}
    assert len(starts) == 1 and not any("\x1b" in x for x in lines)
    assert lines[-1] == "Found 2 secrets (2 critical)."
    painted = _written(_found(spark, "a.txt"), "table", colour=True)
    assert "\x1b[1;31mCRITICAL\x1b[0m" in painted and "\x1b[1;31m1 critical\x1b[0m" in painted
    assert documents.width("e\u0301日") == 3


def test_files_of_reports(spark, tmp_path, capsys):
    path = documents.report(_found(spark, "a.txt"), str(tmp_path / "out"), "sarif")
    assert path.endswith("out.sarif") and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert documents.report(_found(spark, "a.txt"), str(tmp_path / "g.txt"), "github") == ""
    assert capsys.readouterr().out.startswith("::error file=a.txt,line=2,") and not (tmp_path / "g.txt").exists()
    head, row = open(documents.report(_found(spark, "=a.txt"), str(tmp_path / "c.x"), "csv")).read().splitlines()
    assert head.split(",") == list(reports.CSV_COLUMNS) and "'=a.txt" in row
    with pytest.raises(ValueError):
        documents.report(_found(spark, "a.txt"), "", "xml")


def test_order_of_settings():
    file = config.parsed("scan: {max-file-size: 5}\nfilter: {exclude-detectors: [jwt]}\noutput: {format: csv}\nunknown: 1\n")
    got = config.resolve({"output.format": "sarif", "filter.exclude-detectors": ["npm-token"]}, {"LODESIFT_SCAN_MAX_FILE_SIZE": "7", "LODESIFT_OUTPUT_FORMAT": "table"}, file)
    assert (got["scan.max-file-size"], got["output.format"], got["filter.exclude-detectors"], got["verification.timeout"]) == (7, "sarif", ["jwt", "npm-token"], "10s")
    assert config.from_file("/nowhere/x.yaml") == {}
    assert config.seconds("1m30s") == 90 and config.seconds(1_000_000) == pytest.approx(0.001)


@pytest.mark.parametrize("given", [{"output.format": "xml"}, {"scan.max-file-size": 0}, {"scan.max-file-size": (1 << 30) + 1}, {"detection.entropy.threshold": 8.5}, {"verification.timeout": 10}, {"verification.rate-limit": 0}, {"output.severity-threshold": "huge"}, {"output.show-raw": "perhaps"}, {"x": 1}])
def test_settings_out_of_range(given):
    with pytest.raises(ValueError):
        config.resolve(given, {})


def test_settings_of_verification_count_if_it_is_on():
    assert config.resolve({"verification.enabled": False, "verification.rate-limit": 0}, {})["verification.rate-limit"] == 0


@pytest.mark.parametrize("text", ["a: [", "- 1"])
def test_malformed_settings(text):
    with pytest.raises(ValueError):
        config.parsed(text)


@pytest.mark.parametrize(("target", "want"), [("git@host:a/b.git", (True, "git@host:a/b.git")), ("HTTPS://u:p@h/x", (True, "https://u:p@h/x")), ("C:/a", (False, "C:/a")), ("a:b", (False, "a:b")), ("ssh://h/x", (True, "ssh://h/x"))])
def test_addresses(target, want):
    assert targets.classify(target) == want


@pytest.mark.parametrize("target", ["file:///etc", "ftp://h/x", "https://h/a b", "://x"])
def test_addresses_that_are_refused(target):
    with pytest.raises(ValueError):
        targets.classify(target)


def test_sources_that_fail_leave_the_others(spark, tmp_path):
    good = lambda p: lambda: spark.createDataFrame([(p, TOKEN, "r"), ("n", None, "r")], "file_path string, data string, repository string")

    def bad():
        raise OSError("can't reach https://me:pw@host/r")

    run = runs.scan_sources(spark, {"b": good("b.txt"), "https://me:pw@host/r": bad, "a": good("a.txt")}, f"file://{tmp_path}/f", ONLY, 2)
    assert [(r.file_path, r.scanned_source, r.repository) for r in run.findings.collect()] == [("a.txt", "a", "r"), ("b.txt", "b", "r")]
    assert (run.chunks, run.errors, run.exit_code()) == (2, {"https://host/r": "can't reach https://host/r"}, 2)
    assert "pw" not in runs.told(run, "git", "https://me:pw@host/r")
    assert [r.file_path for r in runs.finished(run, "critical", "a.*\n", True).findings.collect()] == ["b.txt"]
    none = runs.scan_sources(spark, {"x": bad}, f"file://{tmp_path}/g", ONLY)
    assert none.findings is None and none.exit_code() == 2 and runs.finished(none, "low").findings is None


def test_command_line(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / ".env").write_text(f"A={TOKEN}\n")
    (tmp_path / "t" / "ok.txt").write_text("nothing\n")
    out = tmp_path / "found"
    none = ["--config", str(tmp_path / "none.yaml"), "--ignore-file", str(tmp_path / "none")]
    assert main([str(tmp_path / "t"), *none, "--format", "json", "--output", str(out)]) == 1
    assert {x["detector_id"] for x in json.loads((tmp_path / "found.json").read_text())} >= {"github-token"}
    assert main([str(tmp_path / "t"), *none, "--exclude", "**/.env", "--output", str(out)]) == 0
    assert main([str(tmp_path / "t"), *none, "--max-file-size", "0"]) == 2
