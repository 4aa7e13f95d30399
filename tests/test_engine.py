import json
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodesift.functions import globs, values
from lodesift.operators import contextual, findings, paths, providers, registry, verification
from lodesift.operators.scan import HELD, Prefilter, ScanOptions, scan, scan_batch
from lodesift.plans import catalog
from lodesift.sinks import reports
from lodesift.sources.files import files
from lodesift.streaming.files import report

TOKEN = "ghp_" + "a1B2" * 9


def _chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, data string")


def _rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_catalog_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = _rows(df, *cols)
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_scan_tells_place_line_and_id(spark):
    found = scan(_chunks(spark, ("a.txt", f"é\r\nx {TOKEN}\n"), ("b.txt", None), ("c.txt", "")), ScanOptions(only=("github-token",)))
    id = values.finding_id("github-token", "****a1B2", "a.txt", 2, 6)
    assert _rows(found, "file_path", "line", "byte_start", "byte_end", "redacted", "id") == [("a.txt", 2, 6, 6 + len(TOKEN), "****a1B2", id)]


def test_findings_of_a_batch_come_in_parts():
    data = [(TOKEN + "\n") * 40] * 200 + [None, "none"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(202)), "path": ["f"] * 202, "line": pa.array([0] * 202, pa.int32()), "data": pa.array(data, pa.binary())})
    prefilter = Prefilter(tuple(registry.select((), (), ("github-token",))))
    parts = list(scan_batch(batch, prefilter, ScanOptions(), False))
    assert max(p.num_rows for p in parts) < HELD + 40
    assert [(r["k"], r["line"]) for p in parts for r in p.to_pylist()] == [(k, n + 1) for k in range(200) for n in range(40)]


def test_repeated_values_have_places_of_their_own(spark):
    found = scan(_chunks(spark, ("a", f"{TOKEN} {TOKEN}\n{TOKEN}")), ScanOptions(only=("github-token",)))
    n = len(TOKEN)
    assert sorted(_rows(found, "byte_start", "line")) == [(0, 1), (n + 1, 1), (2 * n + 2, 2)]


def test_markers_silence_lines(spark):
    data = "\n".join(f"{TOKEN} {mark}" for mark in ("", "# lodesift:ignore", "# lodesift:ignore:github-token", "# lodesift:ignore:github-token-x"))
    found = scan(_chunks(spark, ("a", data)), ScanOptions(only=("github-token",), tag="lodesift:ignore"))
    assert sorted(r[0] for r in _rows(found, "line")) == [1, 4]


def test_rules_of_the_user(spark):
    rules = ({"id": "ours", "regex": "our-[0-9]{4}", "severity": "low", "keywords": ["our-"]}, {"id": "bad", "regex": "(", "severity": "low"}, {"id": "jwt", "regex": "x", "severity": "low"})
    with pytest.warns(UserWarning):
        found = scan(_chunks(spark, ("a", "our-1234 our-12")), ScanOptions(rules=rules, only=("ours",)))
    assert _rows(found, "detector_id", "severity", "byte_start") == [("ours", "low", 0)]
    with pytest.raises(ValueError, match="no detector"):
        registry.select(only=("nothing",))


def test_empty_tables_have_no_findings(spark):
    found = scan(_chunks(spark).limit(0))
    assert found.count() == 0 and findings.summary(found) == "Found 0 secrets."
    assert findings.rule_index(found).count() == 0 and reports.annotations(found).count() == 0


def test_raw_values_stay_out_of_reports(spark):
    found = scan(_chunks(spark, ("a", TOKEN)), ScanOptions(only=("github-token",)))
    assert "raw" not in found.columns
    assert TOKEN not in reports.json_rows(found).first()[0] + reports.annotations(found).first()[0]


def test_capabilities():
    kinds = [verification.kind(d) for d in registry.BUILT_IN]
    assert len(kinds) == 65 and [kinds.count(k) for k in ("live", "requires_context", "format_only", "none")] == [39, 9, 6, 11]


def test_each_value_is_asked_for_once_and_errors_are_contained(spark):
    other = "ghp_" + "Zz9y" * 9

    def transport(request):
        assert request.url == "https://api.example.org/user"
        if request.headers["Authorization"].endswith("a1B2"):
            return providers.Answer(200, b'{"login":"a"}', {"content-type": "application/json"})
        raise RuntimeError("quotes the value")

    found = scan(_chunks(spark, ("a", f"{TOKEN}\n{other}"), ("b", TOKEN)), ScanOptions(only=("github-token",)), keep_raw=True)
    done = verification.verified(found, transport, 2, rate=0, origins={"github-token": "https://API.example.org/"})
    assert "raw" not in done.columns and "_key" not in done.columns
    assert sorted(_rows(done, "file_path", "line", "status")) == [("a", 1, "verified_active"), ("a", 2, "verify_error"), ("b", 1, "verified_active")]
    assert findings.only_verified(done).count() == 2
    assert {r[0] for r in _rows(verification.verified(found, transport, 2, rate=0), "status")} == {"unverified"}  # no origin is trusted


def _ask(detector_id, value, answers, context=None, **more):
    asked, slept = [], []
    answers = iter(answers)

    def transport(request):
        asked.append(request)
        return next(answers)

    status = providers.ask(detector_id, value, context or {}, transport, providers.Limiter(0, sleep=slept.append), **more)
    return status, asked, slept


def test_regions_budgets_and_retries():
    no, yes, busy = providers.Answer(401), providers.Answer(200), providers.Answer(429, headers={"Retry-After": "1"})
    status, asked, _ = _ask("mailgun-api-key", "key-1", [no, yes])
    assert status == "verified_active" and [r.url.split("/")[2] for r in asked] == ["api.mailgun.net", "api.eu.mailgun.net"]
    assert _ask("mailgun-api-key", "key-1", [no, no])[0] == "verified_inactive"
    assert _ask("mailgun-api-key", "key-1", [providers.Answer(500)])[0] == "verify_error"
    status, asked, slept = _ask("doppler-token", "dp", [busy, yes])
    assert status == "verified_active" and len(asked) == 2 and slept == [1.0]
    assert _ask("doppler-token", "dp", [busy, busy])[0] == "verify_error"
    assert _ask("doppler-token", "dp", [providers.Answer(429, headers={"Retry-After": "60"})])[0] == "verify_error"
    assert len(_ask("slack-token", "x", [busy])[1]) == 1  # a POST isn't sent again
    body = b'{"errors":[{"message":"authentication required"}]}'
    denied = providers.Answer(401, body, {"Content-Type": "application/json"})
    assert _ask("newrelic-api-key", "n", [denied, denied])[0] == "verified_inactive"
    assert _ask("newrelic-api-key", "n", [providers.Answer(500), denied])[0] == "verify_error"


def test_what_is_not_asked():
    assert _ask("okta-api-token", "v", [])[:2] == ("unverified", [])
    assert _ask("github-oauth-token", "ghr_x", [], origin="https://a.example")[0] == "unverified"
    assert _ask("gitlab-pat", "gldt-x", [], origin="https://a.example")[0] == "unverified"
    assert _ask("jwt", "v", [])[0] == "unverified" and _ask("slack-token", " ", [])[0] == "unverified"
    status, asked, _ = _ask("github-oauth-token", "ghs_x", [providers.Answer(200, b'{"repositories":[]}', {"Content-Type": "application/json"})], origin="https://a.example")
    assert status == "verified_active" and asked[0].url == "https://a.example/installation/repositories"
    status, asked, _ = _ask("bitbucket-app-password", "v", [providers.Answer(401)], {"username": "u"})
    assert status == "verified_inactive" and asked[0].headers["Authorization"] == "Basic dTp2"


@pytest.mark.parametrize("text", ["http://a.example", "https://u@a.example", "https://a.example/x", "https://a.example?q", "https://127.0.0.1", "https://[::1]", "https://0x7f.1", "https://localhost", "https://x.localhost.", "https://a.example:0", "https://*.example", ""])
def test_origins_that_are_not_trusted(text):
    with pytest.raises(ValueError, match="origin|port"):
        providers.trusted_origin(text)


def test_rate_is_kept():
    clock = [0.0]
    limiter = providers.Limiter(2.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(10):
        limiter.wait("a")
    assert 3.9 <= clock[0] <= 4.1


@pytest.mark.parametrize(
    ("id", "raw", "second", "good"),
    [
        ("azure-entra-secret", "a" * 34, None, True),
        ("azure-entra-secret", "a" * 33, None, False),
        ("azure-storage-key", "AccountName=n;ACCOUNTKEY=YWJj", None, True),
        ("azure-storage-key", "AccountName=n;AccountKey=!", None, False),
        ("coinbase-api-key", "A" * 65, None, False),
        ("gcp-service-account", "x", '{"type":"service_account","project_id":"p","private_key_id":"k","client_email":"e"}', True),
        ("gcp-service-account", "x", "no json", False),
        ("rabbitmq-connection-string", "amqps://u:p@h/v", None, True),
        ("rabbitmq-connection-string", "amqp://:p@h", None, False),
        ("snowflake-credentials", "long enough", "a.snowflakecomputing.com", True),
        ("snowflake-credentials", "short", None, False),
        ("jwt", "x", None, None),
    ],
)
def test_forms(spark, id, raw, second, good):
    df = spark.createDataFrame([(id, raw, second)], "id string, raw string, second string")
    assert df.select(verification.well_formed(F.col("id"), F.col("raw"), F.col("second"))).first()[0] is good


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("*.py", "a/b.py", True), ("a/*.py", "a/b/c.py", False), ("dir/", "x/dir/y", True), ("dir/", "x/dir", False), ("**/t/*.c", "a/b/t/x.c", True), ("**/t/*.c", "t/x.c", True), ("[", "[", False), ("a?c", "x/abc", True), ("[^a]b", "ab", False)],
)
def test_globs(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert globs.matches(path, [glob]) is hit
    assert df.select(globs.covers(F.col("p"), [glob])).first()[0] is hit


def test_ignore_files(spark):
    df = spark.createDataFrame([("a.log",), ("keep.log",), ("b.txt",)], "file_path string")
    assert sorted(r[0] for r in findings.without_ignored(df, "# logs\n*.log\n\n!keep.log\n").collect()) == ["b.txt", "keep.log"]


def test_exit_codes():
    assert [findings.exit_code(0), findings.exit_code(2), findings.exit_code(2, True), findings.exit_code(0, True), findings.exit_code(1, failed=True)] == [0, 1, 1, 3, 2]


def _tree(root):
    for name, data in {"sub/a.env": f"T={TOKEN}\n", ".env": TOKEN, ".aws/credentials": TOKEN, "_cfg/b c.txt": TOKEN, "_x.yml": TOKEN, ".git/config": TOKEN, "sub/.git/config": TOKEN, "go.sum": TOKEN, "x.PNG": TOKEN, "empty": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(data)
    (root / "bin").write_bytes(b"\x00" + TOKEN.encode())
    (root / "utf16").write_bytes(b"\xff\xfe\x00")
    (root / "link").symlink_to(root / ".env")


def test_files_with_hidden_names(spark, tmp_path):
    _tree(tmp_path / "in")
    names = lambda x: sorted(r[0] for r in files(spark, x).select("file_path").collect())
    every = [".aws/credentials", ".env", "_cfg/b c.txt", "_x.yml", "sub/a.env", "utf16"]
    root = str(tmp_path / "in")
    assert names(root) == names(f"file://{root}") == every
    assert names([root, f"{root}/sub", f"{root}/.env"]) == every  # once each, by the first root
    assert names(f"{root}/.git") == ["config"] and names(f"{root}/.env") == [".env"]
    with pytest.raises(OSError):
        files(spark, f"{root}/none")


def test_files_that_arrive(spark, tmp_path):
    _tree(tmp_path / "in")
    options, root, to, checkpoint = ScanOptions(only=("github-token",)), *(str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    assert report(spark, root, to, checkpoint, options) == 10
    (tmp_path / "in" / "later").mkdir()
    (tmp_path / "in" / "later" / ".new").write_text(TOKEN)
    assert report(spark, root, to, checkpoint, options) == 1 and report(spark, root, to, checkpoint, options) == 0
    out = [json.loads(r[0]) for r in spark.read.option("recursiveFileLookup", True).text(to).collect()]
    assert sorted(x["source"]["file_path"] for x in out) == [".aws/credentials", ".env", "_cfg/b c.txt", "_x.yml", "later/.new", "sub/a.env"]
    assert {(x["detector_id"], x["verification"]["status"]) for x in out} == {("github-token", "unverified")}


@pytest.mark.parametrize(("rule", "text", "want"), [(r"\p{L}+", "é1b", ["é", "b"]), (r"a\z", "a\n", []), (r"x$", "x\n", []), (r"[é]{3}", "éé é", []), (r"\x{41}b", "Ab", ["Ab"]), (r"a\sb", "a\vb a b", ["a b"]), (r"\Qa.b\E", "axb a.b", ["a.b"]), (r"[*+]+", "a+*", ["+*"])])
def test_dialect_of_rules(rule, text, want):
    assert [m.raw.decode() for m in registry.custom({"id": "r", "regex": rule}).find(text.encode())] == want


@pytest.mark.parametrize("rule", ["(?U)a+", "(?=a)b", r"(a)\1", "a++", "(", "(?>a)"])
def test_rules_that_the_dialect_lacks(rule):
    with pytest.raises(ValueError, match="r: "):
        registry.custom({"id": "r", "regex": rule})


def test_connection_strings_cost_in_proportion():
    took = []
    for n in (20_000, 40_000):
        start = time.perf_counter()
        assert len(contextual.database(b"Server=a;b " * n + b"'password=x1")) == 0
        took.append(time.perf_counter() - start)
    assert took[1] < 3.5 * took[0] + 0.2


def test_csv_cells(spark):
    found = spark.createDataFrame([("1", "=x", "high", "****", "@a", 0)], "id string, detector_id string, severity string, redacted string, file_path string, line int")
    assert tuple(reports.csv_rows(found).first()) == ("1", "'=x", "high", "****", "", "'@a", "", "", "unverified", "")


def test_names_of_skipped_files(spark):
    df = spark.createDataFrame([("a/go.sum",), ("a/GO.SUM",), ("x.Zip",), ("x.md",), ("a.zip/b",)], "p string")
    assert [r[0] for r in df.select(paths.skipped(F.col("p"), (".MD",))).collect()] == [True, False, True, True, False]
