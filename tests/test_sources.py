import hashlib
import io
import random
import tarfile
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodesift.sources import chat, history, images
from lodesift.sources.files import objects

A, B, C = "aaaa" * 10, "bbbb" * 10, "abab" * 10


def _history(spark):
    day = lambda d: datetime(2024, 1, d)
    commits = spark.createDataFrame([(A, None, day(1), "x"), (B, A, day(2), "y"), (C, B, day(3), None)], "commit string, parent string, ts timestamp, author string")
    changes = spark.createDataFrame([(A, "a.txt", "1", "A"), (B, "a.txt", "2", "M"), (C, "a.txt", "1", "M"), (B, "go.sum", "3", "A"), (C, "b.txt", "4", "A"), (C, "gone", None, "D"), (B, "x.png", "5", "A"), (A, "none", "9", "A")], "commit string, path string, blob string, op string")
    blobs = spark.createDataFrame([("1", b"one"), ("2", b"two"), ("3", b"lock"), ("4", b"a\x00b"), ("5", b"text")], "blob string, data binary")
    return commits, changes, blobs


def test_history_takes_each_blob_once_at_its_newest_commit(spark):
    found = history.history(*_history(spark))
    assert sorted((r.commit, r.file_path, bytes(r.data), r.author) for r in found.collect()) == [(C, "a.txt", b"one", None), (B, "a.txt", b"two", "y"), (B, "x.png", b"text", "y")]


def test_history_from_a_commit_or_time_on(spark):
    commits, changes, blobs = _history(spark)
    assert [r.commit for r in history.history(commits, changes, blobs, since_commit="bbbb").collect()] == [C]
    assert {r.commit for r in history.history(commits, changes, blobs, since=datetime(2024, 1, 2)).collect()} == {B, C}
    assert history.history(commits.limit(0), changes, blobs).count() == 0
    for wrong in ("abc", "zzzz", "cccc"):
        with pytest.raises(ValueError, match="hex digits|no commit"):
            history.resolve(commits, wrong)
    with pytest.raises(ValueError, match="several"):
        history.resolve(commits.unionByName(commits.withColumn("commit", F.concat(F.lit("abab"), F.substring("commit", 5, 36)))), "abab")


def test_history_follows_ancestry(spark):
    """c2 is the boundary; c3, its child, has an older clock; d is on another branch that c4 merges; e is older than c2."""
    day = lambda d: datetime(2024, 1, d)
    rows = [("c1" * 20, [], day(1)), ("c2" * 20, ["c1" * 20], day(9)), ("c3" * 20, ["c2" * 20], day(5)), ("d0" * 20, ["c1" * 20], day(10)), ("e0" * 20, ["c1" * 20], day(2)), ("c4" * 20, ["c3" * 20, "d0" * 20, "e0" * 20], day(11)), ("ab" * 20, [], day(3))]
    commits = spark.createDataFrame(rows, "commit string, parents array<string>, ts timestamp")
    got = lambda since: {r.commit[:2] for r in history.walked(commits, since).collect()}
    assert got("c2" * 20) == {"c4", "d0", "c3"}
    assert got("c4" * 20) == set()
    with pytest.raises(ValueError, match="no ancestor"):
        history.walked(commits, "ab" * 20)


def test_history_by_chains_is_the_walk(spark, monkeypatch):
    """Random graphs with skewed clocks and merges, in blocks of a few commits, for each boundary."""
    monkeypatch.setattr(history, "BLOCK", 7)
    rng = random.Random(11)
    rows = []
    for repo in range(12):
        name = [hashlib.sha1(f"{repo} {i}".encode()).hexdigest() for i in range(40)]
        for i in range(40):
            parents = [name[max(0, i - rng.choice([1, 1, 1, 1, 2, 5]))]] if i and rng.random() < 0.97 else []
            parents += [name[rng.randrange(i)]] if i and rng.random() < (0, 0.1, 0.4)[repo % 3] else []
            rows.append((str(repo), name[i], parents, datetime.fromtimestamp(1_600_000_000 + i * 60 + rng.randrange(-200, 200) * (repo % 4))))
    commits = spark.createDataFrame(rows, "repository string, commit string, parents array<string>, ts timestamp")
    graph = pd.DataFrame([(r, c, p, t.timestamp()) for r, c, p, t in rows], columns=["repository", "commit", "parents", "seconds"])
    for repo, _, _, _ in rows[::80]:
        own = graph[graph.repository == repo]
        since = own["commit"].iloc[17]
        walked = history._walk(own, since)
        before, told = history.met(commits, since)
        assert bool(told.agg(F.max("reached")).first()[0]) == bool(walked.reached.any())
        if walked.reached.any():
            assert sorted(r.commit for r in before.collect()) == sorted(c for c in walked.commit if c)


def test_history_holds_chains_alone():
    """A line of commits with skewed clocks is one chain, so one task needs a row for it and not for each commit."""
    n = 5000
    seconds = [i * 60 - 200 * (i % 5 == 0) for i in range(n)]
    block = pa.table({"repository": [""] * n, "block": pa.array([0] * n, pa.int32()), "commit": [f"{i:05d}" for i in range(n)], "children": [1] * (n - 1) + [0], "seconds": seconds, "parents": [[f"{i - 1:05d}"] if i else [] for i in range(n)], "parent": [f"{i - 1:05d}" if i else None for i in range(n)]})
    chains = history._contract(block, "02500")
    assert chains.num_rows == 2
    told = history._walk_chains(chains)
    assert sorted(history._expand(block, told.slice(1), "02500")["commit"].to_pylist()) == [f"{i:05d}" for i in range(2501, n)]


def test_changes_are_against_the_first_parent(spark):
    commits, _, _ = _history(spark)
    trees = spark.createDataFrame([(A, "a", "1"), (B, "a", "1"), (B, "b", "2"), (C, "a", "3")], "commit string, path string, blob string")
    assert sorted(map(tuple, history.changed(trees, commits).collect())) == sorted([(A, "a", "1", "A"), (B, "b", "2", "A"), (C, "a", "3", "M")])


def test_chat_messages_and_attachments(spark):
    file = "struct<id:string,name:string,mimetype:string>"
    rows = [("C1", "dev", "u", "100.5", None, "hello", [("f1", "a.txt", "text/plain; charset=utf-8"), ("f2", "b.png", "image/png")]), ("C2", "ops", "u", "99.000001", "98.0", "", [("f1", "a.txt", None), (None, "x", None)]), ("C3", "off", None, "200", None, "out", None)]
    messages = spark.createDataFrame(rows, f"channel string, channel_name string, user string, ts string, thread_ts string, text string, files array<{file}>")
    contents = spark.createDataFrame([("f1", "tôken\n".encode()), ("f2", b"png")], "id string, data binary")
    found = chat.chat(messages, contents, exclude=["off"])
    assert sorted((r.channel, r.file_path, bytes(r.data).decode(), r.thread_ts) for r in found.collect()) == [("C1", "", "hello", None), ("C2", "a.txt", "tôken\n", "98.0")]
    assert [r.channel for r in chat.chat(messages, contents, include=["dev", "ops"], since=100).orderBy("file_path").collect()] == ["C1", "C1"]
    assert chat.chat(messages.limit(0), contents).count() == 0


def test_probable_text(spark):
    cases = [(b"plain\ttext\r\n", True), (b"", False), (None, False), (b"a\x00b", False), (b"\xff\xfe", False), (b"a" * 95 + b"\x01" * 5, True), (b"a" * 94 + b"\x01" * 6, False), ("\u00a0".encode() * 3, False), ("é漢".encode(), True)]
    found = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "i int, data binary").select("i", chat.probably_text(F.col("data"))).orderBy("i").collect()
    assert [r[1] for r in found] == [x for _, x in cases]


def test_paths_that_lead_out_are_refused(spark):
    cases = {"a/b": "a/b", "./a//b/../c": "a/c", "../x": None, "a/../../x": None, "/etc/x": None, "C:\\x": None, "..\\x": None, "\\\\host\\x": None, "..x/y": "..x/y", "a/..": "."}
    found = spark.createDataFrame([(x,) for x in cases], "name string").select("name", images.safe_path(F.col("name"))).collect()
    assert {r[0]: r[1] for r in found} == cases


def test_image_files_and_configuration(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in (("app/.env", b"K=v"), ("usr/lib/x.txt", b"x"), ("app/go.sum", b"x"), ("app/a.png", b"x"), ("../up", b"x"), ("app/bin", b"a\x00"), ("empty", b"")):
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    layers = spark.createDataFrame([("i", "sha", 0, out.getvalue()), ("i", "none", 1, None)], "image string, layer string, layer_idx int, data binary")
    assert [(r.file_path, bytes(r.data), r.layer_idx) for r in images.image_files(images.entries(layers)).collect()] == [("app/.env", b"K=v", 0)]
    with pytest.raises(Exception, match="unpacks to more"):
        images.entries(layers, layer_bytes=4).count()
    configs = spark.createDataFrame([("i", ["A=1", "B=2"], {"z": "1", "b": "2"}, ["sh", "-c"], None), ("j", None, None, [], None)], "image string, env array<string>, labels map<string,string>, entrypoint array<string>, cmd array<string>")
    assert [(r.image, bytes(r.data).decode(), r.layer_idx) for r in images.image_configs(configs).collect()] == [("i", "ENV A=1\nENV B=2\nLABEL b=2\nLABEL z=1\nENTRYPOINT sh -c\n", -1)]


def test_objects_are_named_by_bucket_and_key(spark, tmp_path):
    for name, data in (("d/a.txt", b"x"), ("go.sum", b"y"), ("b.png", b"z"), ("empty", b""), ("n", b"\x00")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = objects(spark, str(tmp_path), "bucket")
    assert sorted((r.file_path, bytes(r.data)) for r in found.collect()) == [("bucket/d/a.txt", b"x"), ("bucket/go.sum", b"y")]
