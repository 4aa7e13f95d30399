"""Repository history as chunks, from three exported tables.

commits: (commit, parent, ts, and optionally repository, parents, author, email, branch), parent being the first
parent or null. changes: (commit, path, blob, op), each against the first parent, op D for a deletion.
blobs: (blob, data). All of it is joins and aggregations; texts meet the plan only after repeated blobs are gone."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.globs import covers
from lodesift.operators import paths

#: Bytes in which a NUL tells a binary blob.
HEAD = 8000


def resolve(commits: DataFrame, prefix: str) -> str:
    """The commit that a prefix of 4 to 40 hex digits names; an error if none or several do."""
    if not 4 <= len(prefix) <= 40 or set(prefix.lower()) - set("0123456789abcdef"):
        raise ValueError(f"{prefix!r} isn't 4 to 40 hex digits")
    found = [r[0] for r in commits.where(F.col("commit").startswith(prefix.lower())).select("commit").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{prefix!r} names {'several commits' if found else 'no commit'}")
    return found[0]


def changed(trees: DataFrame, commits: DataFrame) -> DataFrame:
    """changes from whole trees (commit, path, blob): what a commit adds or alters against its first parent."""
    before = trees.select(F.col("commit").alias("parent"), "path", F.col("blob").alias("was"))
    after = trees.join(commits.select("commit", "parent"), "commit")
    both = after.join(before, ["parent", "path"], "left").where(~F.col("blob").eqNullSafe(F.col("was")))
    return both.select("commit", "path", "blob", F.when(F.col("was").isNull(), "A").otherwise("M").alias("op"))


WALKED = "repository string, commit string, place long, reached boolean"


def _walk(graph: pd.DataFrame, since: str | None) -> pd.DataFrame:
    """graph: repository, commit, parents, seconds of one repository. Commits in the order in which a walk from the heads
    meets them, the latest known first, up to a boundary, which is left out; reached tells whether it was met."""
    parents = dict(zip(graph["commit"], graph["parents"], strict=True))
    at = dict(zip(graph["commit"], graph["seconds"], strict=True))
    of_some = {p for own in parents.values() for p in own}
    latest = max((c for c in parents if c not in of_some), key=lambda c: (at[c], c), default=None)
    queue = [] if latest is None else [(-at[latest], latest)]
    seen, out, reached = {latest}, [], False
    while queue:
        _, commit = heapq.heappop(queue)
        if commit == since:
            reached = True
            break
        out.append(commit)
        for parent in parents[commit]:
            if parent in at and parent not in seen:
                seen.add(parent)
                heapq.heappush(queue, (-at[parent], parent))
    rows = out or [None]
    return pd.DataFrame({"repository": graph["repository"].iloc[0], "commit": rows, "place": range(len(rows)), "reached": reached})


def _graph(commits: DataFrame) -> DataFrame:
    """(repository, commit, parents, seconds)."""
    parents = F.coalesce("parents", F.array().cast("array<string>")) if "parents" in commits.columns else F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent"))
    repository = F.col("repository") if "repository" in commits.columns else F.lit("")
    return commits.select(repository.alias("repository"), "commit", parents.alias("parents"), F.unix_micros("ts").alias("seconds"))


def walk(commits: DataFrame, since_commit: str | None = None) -> DataFrame:
    """(repository, commit, place, reached): the commits that a walk from each repository's latest head meets, before it
    meets the boundary, in their order. Repositories are walked by a task each, which holds the whole graph: hashes and
    times. Parents are those of a column `parents` (array), or `parent`; without a column `repository` there is one.
    Where the order doesn't matter, met() tells the same commits and holds far less."""
    return _graph(commits).groupBy("repository").applyInPandas(lambda g: _walk(g, since_commit), WALKED)


#: Commits in a block, about; cells of the range of their times, of which blocks are made.
BLOCK, CELLS = 1 << 17, 1 << 14


def blocks(df: DataFrame, by: str) -> DataFrame:
    """df with its rows' block and how many rows are in the blocks before (block, before). Blocks are ranges of `by`, a
    column of numbers, of about BLOCK rows; equal numbers are in one block, nulls in the first. They are told from the
    counts of CELLS cells of equal width, so they are the same whenever they are computed."""
    low, high, rows = df.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    if rows <= BLOCK or low is None:
        return df.withColumn("block", F.lit(0)).withColumn("before", F.lit(0).cast("long"))
    at = F.least(F.lit(CELLS - 1), F.coalesce(((F.col(by) - F.lit(low)).cast("double") / float(high - low + 1) * CELLS).cast("int"), F.lit(0)))
    celled = df.withColumn("__cell", at)
    counts = sorted((r[0], r[1]) for r in celled.groupBy("__cell").count().collect())  # CELLS rows at most
    before = [0, *accumulate(n for _, n in counts)]
    starts: dict[int, int] = {}
    for k in before[:-1]:
        starts.setdefault(k // BLOCK, k)
    told = [(cell, k // BLOCK, starts[k // BLOCK]) for (cell, _), k in zip(counts, before, strict=False)]
    return celled.join(F.broadcast(df.sparkSession.createDataFrame(told, "__cell int not null, block int not null, before long not null")), "__cell").drop("__cell")


#: A key that is met earlier is smaller: the later time, then the smaller hash. Unknown times come last.
UNKNOWN = -(1 << 62)


def _chains(graph: pa.Table, since: str) -> Iterator[tuple[list[int], list[tuple[int, str]]]]:
    """Of a block (commit, parent, if there is just one, seconds, children) the chains of commits, each of which is the only
    child of the one before it and that one's only parent; and each commit's key. The boundary ends a chain."""
    commit, parent, children = graph["commit"].to_pylist(), graph["parent"].to_pylist(), graph["children"].to_pylist()
    keys = [(-(UNKNOWN if s is None else s), c) for s, c in zip(graph["seconds"].to_pylist(), commit, strict=True)]
    at = {c: i for i, c in enumerate(commit)}
    after = [-1 if p is None or c == since or (i := at.get(p, -1)) < 0 or children[i] != 1 else i for c, p in zip(commit, parent, strict=True)]
    begins = [True] * len(commit)
    for i in after:
        if i >= 0:
            begins[i] = False
    for i, first in enumerate(begins):
        if first:
            chain = []
            while i >= 0:
                chain.append(i)
                i = after[i]
            yield chain, keys


CHAINS = "repository string, block int, head string, newest boolean, at long, low long, low_commit string, ends boolean, parents array<string>"
TOLD = "repository string, block int, head string, low long, low_commit string, reached boolean"


def _contract(graph: pa.Table, since: str) -> pa.Table:
    """A row for each chain of a block: its first commit, whether that has no child, its time; the chain's last key; whether
    the boundary ends it; the parents of its last commit."""
    out, tails = [], []
    repository, block = graph["repository"][0].as_py(), graph["block"][0].as_py()
    children = graph["children"]
    for chain, keys in _chains(graph, since):
        low, (time, head) = max(keys[i] for i in chain), keys[chain[0]]
        out.append((repository, block, head, children[chain[0]].as_py() == 0, -time, -low[0], low[1], keys[chain[-1]][1] == since))
        tails.append(chain[-1])
    kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
    parents = graph["parents"].combine_chunks().take(pa.array(tails, pa.int64())).cast(pa.list_(pa.field("element", pa.string())))
    return pa.table([*columns, parents], names=[x.split()[0] for x in CHAINS.split(", ")])


def _walk_chains(chains: pa.Table) -> pa.Table:
    """The walk of one repository over its chains. A chain is met to its end when its last key is the first in the queue: from
    there on its commits come at once, one after another, as no other commit that waits has an earlier key, and before that no
    chain with a later last key ends. So the ends come in the order of these keys. When the boundary is met, chains that
    have begun but not ended are met up to the first commit whose key is later than all last keys met meanwhile.
    Told for each chain that is met: how far, as a key, or a null commit for to its end; and whether the boundary is met."""
    column = {c: chains[c].to_pylist() for c in chains.column_names}
    index = {h: i for i, h in enumerate(column["head"])}
    latest = max((i for i, new in enumerate(column["newest"]) if new), key=lambda i: (column["at"][i], column["head"][i]), default=None)
    key = lambda i: (-column["low"][i], column["low_commit"][i])
    queue = [] if latest is None else [(key(latest), latest)]
    since, met, ended, reached = {latest: 0}, [], [], False
    while queue and not reached:
        low, i = heapq.heappop(queue)
        met.append(low)
        ended.append(i)
        reached = column["ends"][i]
        for parent in [] if reached else column["parents"][i]:
            if (j := index.get(parent, -1)) >= 0 and j not in since:
                since[j] = len(met)
                heapq.heappush(queue, (key(j), j))
    out = [(column["repository"][0], None, None, None, None, reached)]
    if reached:
        last = list(accumulate(reversed(met), max))[::-1]
        told = [(i, None, None) for i in ended] + [(i, -last[since[i]][0], last[since[i]][1]) for _, i in queue]
        out += [(column["repository"][0], column["block"][i], column["head"][i], low, low_commit, True) for i, low, low_commit in told]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TOLD.split(", ")])


def _expand(graph: pa.Table, told: pa.Table, since: str) -> pa.Table:
    """The commits of a block's chains as far as they are met, without the boundary."""
    until = {h: None if c is None else (-low, c) for h, low, c in zip(*(told[x].to_pylist() for x in ("head", "low", "low_commit")), strict=True)}
    out = []
    for chain, keys in _chains(graph, since) if until else ():
        head = keys[chain[0]][1]
        if head in until:
            last = until[head]
            for i in chain:
                if keys[i][1] == since or (last is not None and keys[i] > last):
                    break
                out.append(keys[i][1])
    return pa.table({"repository": pa.array([graph["repository"][0].as_py()] * len(out) if out else [], pa.string()), "commit": pa.array(out, pa.string())})


def met(commits: DataFrame, since_commit: str) -> tuple[DataFrame, DataFrame]:
    """The commits (repository, commit) that walk() meets before the boundary, in repositories in which it is met; and
    (repository, reached). Blocks of commits of like times are contracted to chains by all tasks, and a task for each
    repository walks the chains alone: for histories whose parents are mostly little older than their children that is a few
    for each block and merge. A graph without chains is walked as by walk()."""
    graph = blocks(_graph(commits), "seconds").drop("before")
    graph = graph.withColumn("parents", F.array_distinct(F.array_compact("parents")))
    # how many children each commit has meets it in one aggregate; commits that come twice are one
    named = graph.select("repository", "commit", F.lit(0).cast("long").alias("children"), F.struct("seconds", "block", "parents").alias("own"))
    asked = graph.select("repository", F.explode("parents").alias("commit"), F.lit(1).cast("long").alias("children"), F.lit(None).cast(named.schema["own"].dataType).alias("own"))
    counted = named.unionByName(asked).groupBy("repository", "commit").agg(F.sum("children").alias("children"), F.max("own").alias("own")).where("own is not null")
    only = F.when(F.size("own.parents") == 1, F.element_at("own.parents", 1))
    dealt = counted.select("repository", "commit", "children", "own.seconds", "own.block", "own.parents", only.alias("parent")).repartition("repository", "block")
    chains = dealt.groupBy("repository", "block").applyInArrow(lambda g: _contract(g, since_commit), CHAINS)
    told = chains.groupBy("repository").applyInArrow(_walk_chains, TOLD)
    bare = dealt.drop("parents").groupBy("repository", "block").cogroup(told.where("head is not null").groupBy("repository", "block"))
    return bare.applyInArrow(lambda g, t: _expand(g, t, since_commit), "repository string, commit string"), told.where("head is null").select("repository", "reached")


def walked(commits: DataFrame, since_commit: str | None = None, since: datetime | None = None) -> DataFrame:
    """commits that come before a boundary in a walk by ancestry, and those from a time on. A boundary that isn't among
    the commits, or that no walk meets, is an error: it is no ancestor, so nothing can be told to come after it."""
    kept = commits
    if since_commit is not None:
        edge = resolve(commits, since_commit)
        before, told = met(commits, edge)
        if not told.agg(F.max("reached")).first()[0]:
            raise ValueError(f"{edge} is no ancestor of the latest commit")
        on = ["repository", "commit"] if "repository" in commits.columns else ["commit"]
        kept = kept.join(before.select(*on), on, "left_semi")
    return kept if since is None else kept.where(F.col("ts") >= F.lit(since))


def first_blobs(commits: DataFrame, changes: DataFrame, globs: Iterable[str] = ()) -> DataFrame:
    """(commit, file_path, blob, and the other columns of commits): each blob at each path once, at the newest of its
    commits. Deletions, lock files and paths that a glob covers are left out. The newest is an aggregate that
    combines before its exchange, so a blob that very many commits carry costs no more than others."""
    own = [c for c in commits.columns if c not in ("ts", "commit", "parent", "parents")]
    kept = changes.where((F.col("op") != "D") & ~paths.lock_file(F.col("path")) & ~covers(F.col("path"), globs))
    newest = kept.join(commits, "commit").groupBy("blob", F.col("path").alias("file_path")).agg(F.max(F.struct("ts", "commit")).alias("newest"), F.max_by(F.struct("ts", "commit", *own), F.struct("ts", "commit")).alias("c"))
    return newest.select("c.commit", "file_path", "blob", F.col("c.ts").alias("date"), *[F.col(f"c.{c}") for c in own])


def binary_blob(data: Column) -> Column:
    return F.hex(F.substring(data, 1, HEAD)).rlike("^(?:..)*?00")


def history(commits: DataFrame, changes: DataFrame, blobs: DataFrame, since_commit: str | None = None, since: datetime | None = None, globs: Iterable[str] = (), largest: int = paths.LARGEST) -> DataFrame:
    """Chunks (file_path, data, source_type, commit, date, and the other columns of commits). Blobs that are missing,
    too large or binary give none; extensions aren't looked at; empty tables give no rows."""
    text = blobs.where((F.length("data") <= largest) & ~binary_blob(F.col("data")))
    found = first_blobs(walked(commits, since_commit, since), changes, globs).join(text, "blob").drop("blob")
    return found.withColumn("source_type", F.lit("git"))
