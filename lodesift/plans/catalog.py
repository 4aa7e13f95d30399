"""The queries over the driver's tables, and their SQL.

The tables hold few credentials of named providers, so each document is scanned together with lines planted after it,
whose values are derived from its id; what its own text holds is found alike."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodesift.functions import columns
from lodesift.functions.globs import covers, ignore_column, parse_ignore
from lodesift.operators import findings, paths, remediation, verification
from lodesift.operators.registry import BUILT_IN
from lodesift.operators.scan import ScanOptions, scan
from lodesift.plans import samples
from lodesift.sinks import reports
from lodesift.sources import chat, history
from lodesift.sources.files import files, texts

#: What is planted: the start of a value, and how many hex digits follow it.
PLANTED = {
    "anthropic-api-key": ("sk-ant-", 90),
    "digitalocean-token": ("dop_v1_", 64),
    "github-token": ("ghp_", 36),
    "gitlab-pat": ("glpat-", 20),
    "huggingface-token": ("hf_", 34),
    "linear-api-key": ("lin_api_", 40),
    "npm-token": ("npm_", 36),
    "rubygems-api-key": ("rubygems_", 48),
    "sonarcloud-token": ("sqp_", 40),
    "stripe-api-key-live": ("sk_live_", 24),
}
#: What redaction shows before the mask.
SHOWN = {"digitalocean-token": "dop_v1_", "gitlab-pat": "glpat-", "huggingface-token": "hf_", "linear-api-key": "lin_api_", "npm-token": "npm_", "rubygems-api-key": "rubygems_", "sonarcloud-token": "sqp_", "stripe-api-key-live": "sk_live_"}
IGNORE = "# generated\nes/**\n!es/1*\n**/*.tmp\nde/\n"
GLOBS = ("*.example.org", "en/[0-4]*", "fr/?")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def planted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a line for each planted value; the first of them comes twice."""
    digits = F.concat(*[F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(salt))) for salt in "abc"])
    value = lambda start, n: F.concat(F.lit(start), F.substring(digits, 1, n))
    lines = [value(*p) for p in PLANTED.values()]
    docs = _documents(spark, sf_dir).withColumn("data", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat_ws("\n", *lines, lines[0]), F.lit("\n")))
    return texts(docs, F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), "data").drop("text")


_CHUNKS = (
    "chunks AS (SELECT doc_id, 'docs/' || doc_id || '.txt' AS file_path, coalesce(text, '') || chr(10) || "
    + " || chr(10) || ".join(f"'{start}' || substr(digits, 1, {n})" for start, n in [*PLANTED.values(), next(iter(PLANTED.values()))])
    + " || chr(10) AS data FROM (SELECT doc_id, text, md5(doc_id || 'a') || md5(doc_id || 'b') || md5(doc_id || 'c') AS digits FROM documents))"
)


def _found_sql(id: str) -> str:
    detector = BUILT_IN[id]
    pattern = detector.pattern.replace("'", "''")
    return f"""SELECT doc_id, file_path, '{id}' AS detector_id, '{detector.severity}' AS severity, hits[k] AS raw, '{SHOWN.get(id, "")}****' || right(hits[k], 4) AS redacted,
  coalesce(list_sum(list_transform(gaps[1:k], lambda x: strlen(x))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: strlen(x))), 0)::BIGINT AS byte_start,
  (1 + length(array_to_string(gaps[1:k], '')) - length(replace(array_to_string(gaps[1:k], ''), chr(10), '')))::INTEGER AS line
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, file_path, regexp_extract_all(data, '{pattern}') AS hits, string_split_regex(data, '{pattern}') AS gaps FROM chunks))"""


_FOUND = f"""WITH {_CHUNKS}, raws AS ({" UNION ALL ".join(map(_found_sql, PLANTED))}),
found AS (SELECT *, byte_start + strlen(raw) AS byte_end, substr(sha256(detector_id || redacted || file_path || line || ':' || byte_start), 1, 32) AS id FROM raws)
"""


def planted_findings(spark: SparkSession, sf_dir: str, keep_raw: bool = False) -> DataFrame:
    return scan(planted_chunks(spark, sf_dir), ScanOptions(only=tuple(PLANTED)), keep=("doc_id",), keep_raw=keep_raw)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over all planted chunks."""
    return scan(planted_chunks(spark, sf_dir), keep=("doc_id",)).drop("extra")


def scan_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_findings(spark, sf_dir).select("doc_id", "file_path", "detector_id", "severity", "redacted", "line", "byte_start", "byte_end", "id")


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_counts(planted_findings(spark, sf_dir))


def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.at_least(planted_findings(spark, sf_dir), "critical").groupBy("detector_id").agg(F.count(F.lit(1)).alias("findings"))


def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ordered(planted_findings(spark, sf_dir)).select("file_path", "line", "detector_id", "redacted", "id")


def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rule_index(planted_findings(spark, sf_dir))


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(planted_findings(spark, sf_dir)).select("rule_id", "level", "message", "fingerprint", "uri", "start_line")


def github_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotations(planted_findings(spark, sf_dir))


def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.csv_rows(planted_findings(spark, sf_dir)).select("id", "detector_id", "severity", "redacted", "file_path", "line", "verification_status")


def remediation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each advice is for."""
    advised = remediation.enriched(planted_findings(spark, sf_dir))
    return advised.groupBy("detector_id", F.col("remediation_title").alias("title"), F.col("remediation_urgency").alias("urgency"), F.size("remediation_steps").alias("steps")).agg(F.count(F.lit(1)).alias("findings"))


def shown_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a login and characters that mislead a reader, as they are shown."""
    login = F.regexp_replace("url", "^(https?://)", "$1me:secret@")
    odd = F.concat(login, F.lit("\x1b[2J\x07"), F.lit(chr(0x202E)), F.col("page_id").cast("string"))
    return _pages(spark, sf_dir).select("page_id", columns.displayable(columns.scrub_url(odd)).alias("shown"))


def verification_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings there are of each detector, and how many values a verification would send."""
    keyed = planted_findings(spark, sf_dir, keep_raw=True).select("detector_id", F.sha2("raw", 256).alias("value"))
    counted = keyed.groupBy("detector_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("detector_id").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("distinct_values"))


def finding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.with_capability(planted_findings(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("findings"))


def capability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.capabilities(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("detectors"))


def http_status_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recorded answers of providers say."""
    rows = [(k, d, code, body, media) for k, (d, code, body, media, _) in enumerate(samples.ANSWERS)]
    recorded = spark.createDataFrame(rows, "answer int, detector_id string, code int, body string, media string")
    return recorded.select("answer", "detector_id", "code", verification.status_of_answer(F.col("detector_id"), F.col("code"), F.col("body"), F.col("media")).alias("status"))


def detector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding of a detector in what it is to find, and none in what it is to pass over: each document stands for a
    sample, in turn, and all detectors scan it."""
    known = spark.createDataFrame([(k, x.detector_id, x.text) for k, x in enumerate(samples.SAMPLES)], "sample int, wanted string, data string")
    docs = _documents(spark, sf_dir).select("doc_id", F.pmod("doc_id", F.lit(len(samples.SAMPLES))).cast("int").alias("sample"))
    chunks = docs.join(F.broadcast(known), "sample").withColumn("path", F.concat(F.lit("sample/"), F.col("doc_id").cast("string")))  # a fixed list
    found = scan(chunks, path_col="path", keep=("doc_id", "sample", "wanted"))
    return found.where("detector_id = wanted").select("doc_id", "sample", "detector_id", "byte_start", "byte_end", "line")


def scan_all_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).withColumn("entropy", F.round("entropy", 6))


def hidden_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the files that a scan opens, of a tree with a file for each nation, hidden ones among them."""
    root = _tree(spark, [r["n_nationkey"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()])  # 25 rows
    found = files(spark, root, globs=("skip/*",))
    return found.select("file_path", F.length("data").cast("long").alias("n_bytes"))


#: Where a file of such a tree stands, in turn.
PLACES = (".env", ".aws/credentials", "_x.yml", ".git/config", "sub/.hidden/a.txt", "_cfg/b c.txt", "plain.txt", "skip/me.txt", "go.sum", "x.PNG")


def _tree(spark: SparkSession, keys: list[int]) -> str:
    """Files in the folder that the machines share, or, where none is set as in tests, in a temporary one."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if shared:
        os.makedirs(shared, exist_ok=True)
    root = tempfile.mkdtemp(prefix="lodesift-tree-", dir=shared or None)
    for k in keys:
        path = os.path.join(root, str(k), PLACES[k % len(PLACES)]) if k % len(PLACES) != 7 else os.path.join(root, "skip", f"{k}.txt")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("x" * (k + 1))
    return root


def history_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a history in which every fifth clock runs behind: what a walk from the last one meets before the
    order in the middle."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    # numbered by ranges of keys, so that no task holds them all
    placed = history.blocks(orders, "key").withColumn("n", F.row_number().over(Window.partitionBy("block", "before").orderBy("key")) + F.col("before"))
    hashed = lambda n: F.md5(F.concat(F.lit("h"), n.cast("string")))
    skewed = F.col("n") * 60 - F.when(F.col("n") % 5 == 0, 200).otherwise(0)
    commits = placed.select(F.col("n"), hashed(F.col("n")).alias("commit"), F.when(F.col("n") > 1, hashed(F.col("n") - 1)).alias("parent"), F.timestamp_seconds(F.lit(1_600_000_000) + skewed).alias("ts"))
    middle = hashed(F.lit(orders.count() // 2))
    return history.walked(commits, spark.range(1).select(middle).first()[0]).select(F.col("n").cast("long").alias("n"), "commit")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefilter_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many planted chunks each detector with keywords would look at, in one pass that stays in the JVM."""
    low = planted_chunks(spark, sf_dir).select(_lower(F.col("data").cast("string")).alias("low"))
    words = {d.id: d.keywords for d in BUILT_IN.values() if d.keywords}

    def any_of(ws: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in ws:
            hit = hit | F.col("low").contains(w.lower())
        return hit

    counted = low.agg(*[F.count_if(any_of(ws)).alias(id) for id, ws in words.items()])
    return counted.unpivot([], list(words), "detector_id", "admitted").where("admitted > 0")


def _prefilter_sql() -> str:
    one = lambda d: " OR ".join("contains(low, '" + w.lower().replace("'", "''") + "')" for w in d.keywords)
    parts = [f"SELECT '{d.id}' AS detector_id, count(*) FILTER ({one(d)}) AS admitted FROM d" for d in BUILT_IN.values() if d.keywords]
    return f"WITH {_CHUNKS}, d AS (SELECT translate(data, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM chunks) SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE admitted > 0"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", path.alias("path"), host.alias("host"))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", covers(F.col("host"), GLOBS[:1]).alias("by_host"), covers(F.col("path"), GLOBS[1:]).alias("by_path"))


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", ignore_column(F.col("path"), parse_ignore(IGNORE)).alias("ignored"))


def skip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of the pages' paths: lock files, binary extensions in either case, and others."""
    names = F.element_at(F.array(*map(F.lit, ("go.sum", "a/yarn.lock", "b.PNG", "c.tar.gz", "d.py", "e", "f.lock"))), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat("path", F.lit("/"), names)
    return _pages(spark, sf_dir).select("page_id", path.alias("path"), paths.skipped(path).alias("skipped"))


def url_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.round(columns.entropy(F.col("url")), 6).alias("entropy"), columns.redact(F.col("url")).alias("redacted"))


def inline_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers on lines made of the pages' paths: bare, for the detector, for one whose id is longer, for another."""
    marks = F.element_at(F.array(*map(F.lit, ("# lodesift:ignore", "# lodesift:ignore:jwt", "# lodesift:ignore:jwt-x", "# lodesift:ignore:npm-token lodesift:ignore", "# lodesift"))), (F.col("page_id") % 5 + 1).cast("int"))
    line = F.concat("path", F.lit(" "), marks)
    return _pages(spark, sf_dir).select("page_id", columns.line_ignored(line, "jwt").alias("ignored"))


def history_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a history: a commit for each, a minute apart, that writes its text to one of a few paths."""
    docs = _documents(spark, sf_dir).withColumn("commit", F.md5(F.concat(F.lit("c"), F.col("doc_id").cast("string")))).withColumn("blob", F.md5("text"))
    before = F.md5(F.concat(F.lit("c"), (F.col("doc_id") - 1).cast("string")))
    commits = docs.select("commit", before.alias("parent"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id") * 60).alias("ts"), "doc_id")
    changes = docs.select("commit", F.concat(F.lit("src/"), F.substring("blob", 1, 1), F.lit(".txt")).alias("path"), "blob", F.when(F.col("text").isNull(), "D").otherwise("A").alias("op"))
    blobs = docs.where("text is not null").groupBy("blob").agg(F.max("text").alias("text")).select("blob", F.col("text").cast("binary").alias("data"))
    found = history.history(commits, changes, blobs)
    return found.select("doc_id", "commit", "file_path", F.unix_seconds("date").alias("committed"), F.length("data").cast("long").alias("n_bytes"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as channels, without what the channel of system messages says."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    messages = talks.select(F.col("conv_id").cast("string").alias("channel"), F.col("role").alias("channel_name"), F.col("role").alias("user"), F.col("turn").cast("string").alias("ts"), F.lit(None).cast("string").alias("thread_ts"), "text")
    found = chat.chat(messages, exclude=["system"])
    return found.select("channel", "channel_name", "message_ts", "source_type", F.length("data").cast("long").alias("n_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_planted, severity_summary, severity_floor, findings_order, sarif_rule_index, sarif_results, github_annotations, csv_report, verification_keys,
        finding_kinds, capability_counts, http_status_mapping, prefilter_selectivity, glob_filter, ignore_rules, skip_files, url_entropy, inline_markers,
        history_chunks, chat_messages, scan_all_detectors, detector_samples, hidden_files, history_since, remediation_titles, shown_addresses,
    )
}

#: What is advised for the planted detectors, by hand.
_TITLES = (
    "('anthropic-api-key', 'Replace the key of Anthropic', 'now'), ('digitalocean-token', 'Revoke the token at DigitalOcean', 'now'), ('github-token', 'Revoke the token at GitHub', 'now'), "
    "('gitlab-pat', 'Revoke the token at GitLab', 'now'), ('huggingface-token', 'Revoke the token at Hugging Face', 'now'), ('linear-api-key', 'Replace the key of Linear', 'today'), "
    "('npm-token', 'Revoke the token at npm', 'today'), ('rubygems-api-key', 'Replace the key of RubyGems', 'today'), ('sonarcloud-token', 'Revoke the token at SonarCloud', 'today'), "
    "('stripe-api-key-live', 'Replace the key of Stripe', 'now')"
)
_DIM = "dim(detector_id, kind) AS (VALUES " + ", ".join(f"('{d}', '{verification.kind(d)}')" for d in BUILT_IN) + ")"
_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'warning' ELSE '{}' END"
_PAGES = r"WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([^?]*)', 1) AS path, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) "
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_RECORDED = ", ".join(f"({k}, {_QUOTED(d)}, {code}, {_QUOTED(status)})" for k, (d, code, _, _, status) in enumerate(samples.ANSWERS))
_WANTED = ", ".join(f"({k}, {_QUOTED(x.detector_id)}, {start}, {end}, {line})" for k, x in enumerate(samples.SAMPLES) for start, end, line in x.spans)

ORACLE_SQL: dict[str, str] = {
    "history_chunks": "SELECT max(doc_id) AS doc_id, md5('c' || max(doc_id)) AS commit, 'src/' || substr(md5(text), 1, 1) || '.txt' AS file_path, 1600000000 + max(doc_id) * 60 AS committed, max(strlen(text))::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL AND strlen(text) <= 10485760 GROUP BY text",
    "chat_messages": "SELECT conv_id::VARCHAR AS channel, role AS channel_name, turn::VARCHAR AS message_ts, 'slack' AS source_type, strlen(text)::BIGINT AS n_bytes FROM conversations WHERE role <> 'system' AND text <> ''",
    "scan_planted": _FOUND + "SELECT doc_id, file_path, detector_id, severity, redacted, line, byte_start, byte_end, id FROM found",
    "severity_summary": _FOUND + "SELECT severity, count(*) AS findings FROM found GROUP BY 1",
    "severity_floor": _FOUND + "SELECT detector_id, count(*) AS findings FROM found WHERE severity = 'critical' GROUP BY 1",
    "findings_order": _FOUND + "SELECT file_path, line, detector_id, redacted, id FROM found ORDER BY 1, 2, 3, 4, 5",
    "sarif_rule_index": _FOUND + "SELECT detector_id, severity, (row_number() OVER (ORDER BY file_path, line, detector_id, redacted, id) - 1)::INTEGER AS rule_index FROM (SELECT *, row_number() OVER (PARTITION BY detector_id ORDER BY file_path, line, detector_id, redacted, id) AS n FROM found) WHERE n = 1",
    "sarif_results": _FOUND + f"SELECT detector_id AS rule_id, {_LEVEL.format('note')} AS level, detector_id || ' matches ' || redacted AS message, substr(sha256(detector_id || chr(0) || redacted || chr(0) || file_path), 1, 32) AS fingerprint, file_path AS uri, line AS start_line FROM found",
    "github_annotations": _FOUND + f"SELECT '::' || {_LEVEL.format('notice')} || ' file=' || file_path || ',line=' || line || ',title=lodesift%3A ' || detector_id || '::' || severity || ' finding ' || redacted || ' of ' || detector_id AS command FROM found",
    "csv_report": _FOUND + "SELECT id, detector_id, severity, redacted, file_path, line::VARCHAR AS line, 'unverified' AS verification_status FROM found",
    "verification_keys": _FOUND + "SELECT detector_id, count(*) AS findings, count(DISTINCT raw) AS distinct_values FROM found GROUP BY 1",
    "finding_kinds": _FOUND.rstrip() + f", {_DIM} SELECT kind, count(*) AS findings FROM found JOIN dim USING (detector_id) GROUP BY 1",
    "http_status_mapping": f"SELECT * FROM (VALUES {_RECORDED}) t(answer, detector_id, code, status)",
    "detector_samples": f"SELECT doc_id, sample, detector_id, byte_start::BIGINT AS byte_start, byte_end::BIGINT AS byte_end, line FROM documents JOIN (VALUES {_WANTED}) t(sample, detector_id, byte_start, byte_end, line) ON doc_id % {len(samples.SAMPLES)} = sample",
    "scan_all_detectors": _FOUND + "SELECT doc_id, file_path, detector_id, severity, redacted, line, byte_start, byte_end, round(list_aggregate(string_split(raw, ''), 'entropy'), 6) AS entropy, id FROM found",
    "hidden_files": "WITH t AS (SELECT n_nationkey AS k, ['.env', '.aws/credentials', '_x.yml', '', 'sub/.hidden/a.txt', '_cfg/b c.txt', 'plain.txt', '', '', ''][n_nationkey % 10 + 1] AS place FROM nation) SELECT k || '/' || place AS file_path, (k + 1)::BIGINT AS n_bytes FROM t WHERE place <> ''",
    "history_since": "WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS m FROM orders) SELECT n, md5('h' || n) AS commit FROM n WHERE n > m // 2",
    "remediation_titles": _FOUND + f"SELECT detector_id, title, urgency, 3 AS steps, count(*) AS findings FROM found JOIN (VALUES {_TITLES}) t(detector_id, title, urgency) USING (detector_id) GROUP BY 1, 2, 3",
    "shown_addresses": r"SELECT page_id, url || '[2J\u202E' || page_id AS shown FROM pages",
    "capability_counts": "SELECT * FROM (VALUES ('live', 39::BIGINT), ('requires_context', 9), ('format_only', 6), ('none', 11)) t(kind, detectors)",
    "prefilter_selectivity": _prefilter_sql(),
    "glob_filter": _PAGES + r"SELECT page_id, regexp_matches(host, '^[^/]*\.example\.org$') AS by_host, regexp_matches(path, '^en/[0-4][^/]*$') OR regexp_matches(path, '^fr/[^/]$') AS by_path FROM p",
    "ignore_rules": _PAGES + r"SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)de/+[^/]') THEN true WHEN regexp_matches(path, '^([^/]+/)*[^/]*\.tmp$') THEN true WHEN regexp_matches(path, '^es/1[^/]*$') THEN false WHEN regexp_matches(path, '^es(/|$)') THEN true ELSE false END AS ignored FROM p",
    "skip_files": _PAGES + "SELECT page_id, path || '/' || n AS path, n IN ('go.sum', 'a/yarn.lock', 'b.PNG', 'c.tar.gz') AS skipped FROM (SELECT *, ['go.sum', 'a/yarn.lock', 'b.PNG', 'c.tar.gz', 'd.py', 'e', 'f.lock'][page_id % 7 + 1] AS n FROM p)",
    "url_entropy": _PAGES + "SELECT page_id, round(list_aggregate(string_split(url, ''), 'entropy'), 6) AS entropy, '****' || right(url, 4) AS redacted FROM p",
    "inline_markers": _PAGES + "SELECT page_id, page_id % 5 IN (0, 1) AS ignored FROM p",
}
