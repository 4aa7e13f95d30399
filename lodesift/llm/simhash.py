"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are a ring of four 16-bit segments. If two fingerprints differ in at most three
bits, then by the pigeonring principle some segment starts a chain whose first l segments differ in at most
l * 3 / 4 bits for every l from 1 to 4: none in the first, at most one in the first two, two in the
first three, three in all. Each fingerprint is therefore dealt out four times, turned so that each segment
comes first; within a partition it is looked up under its first two segments with no or one changed bit
in the second, and pairs must keep the budgets of the longer chains before the full check.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import free_names, map_arrow, materialize, maybe_in, partitions, text_bytes
from lodesift.llm.components import connected_components

SEED = 42
SHINGLE = 3
BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
MOST = 3
#: Pairs of runs with more pairs of members than this are linked by lookups instead of by a list of pairs.
LISTED = 4096
#: Pairs that are listed at once.
AT_ONCE = 1 << 20


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """SimHash of the word n-grams of a UTF-8 text; 0 without words, the whole sequence under n words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < n:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -n] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    table = np.array(hashes, dtype=np.uint64)
    for i in range(0, len(table), 1 << 16):
        ones += np.unpackbits(table[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(table)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, kind: str = "bigint") -> DataFrame:
    """(doc_id, fp long) for each row of docs; null text counts as empty. kind: the type of ids."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x, n) for x in text_bytes(batch.column(1)).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(chosen, step, f"doc_id {kind}, fp bigint")


class Forest:
    """Union-find over 0 to n - 1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def near(x: np.ndarray, most: int = MOST) -> np.ndarray:
    """Of differences of turned fingerprints: those within the budgets of the chains and in all."""
    kept = np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        kept &= np.bitwise_count(x >> np.uint64(BITS - WIDTH * length)) <= length * most // SEGMENTS
    return kept


def ring_links(turned: np.ndarray) -> np.ndarray:
    """turned: distinct fingerprints, sorted, all turned alike. The smallest of what is linked with each one
    by chains that start at the first segment, as positions."""
    keys = turned >> np.uint64(BITS - 2 * WIDTH)
    groups, first, sizes = np.unique(keys, return_index=True, return_counts=True)
    forest = Forest(len(turned))
    for bit in [None, *range(WIDTH)]:
        if bit is None:
            a = b = np.flatnonzero(sizes > 1)
        else:
            other = groups ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(groups, other), len(groups) - 1)
            a = np.flatnonzero((groups[at] == other) & (other > groups))
            b = at[a]
        pairs = sizes[a] * sizes[b]
        for i in np.flatnonzero(pairs > LISTED):
            x, y = int(first[a[i]]), int(first[b[i]])
            other = None if bit is None else (y, y + int(sizes[b[i]]))
            crowded(turned, forest, x, x + int(sizes[a[i]]), other, MOST - (bit is not None))
        a, b, pairs = (x[pairs <= LISTED] for x in (a, b, pairs))
        turn = (np.cumsum(pairs) - 1) // AT_ONCE
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(turn)) + 1):
            _listed(turned, forest, first[a[part]], sizes[a[part]], first[b[part]], sizes[b[part]])
    return forest.roots()


def _listed(turned: np.ndarray, forest: Forest, first: np.ndarray, sizes: np.ndarray, first_b: np.ndarray, sizes_b: np.ndarray) -> None:
    """Links members of runs with members of other runs, all pairs of each small pair of runs."""
    if not len(first):
        return
    pairs = sizes * sizes_b
    of = np.repeat(np.arange(len(first)), pairs)
    nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i, j = first[of] + nth // sizes_b[of], first_b[of] + nth % sizes_b[of]
    kept = (i != j) & near(turned[i] ^ turned[j])
    for x, y in zip(i[kept].tolist(), j[kept].tolist(), strict=True):
        forest.link(x, y)


def crowded(turned: np.ndarray, forest: Forest, lo: int, hi: int, other: tuple[int, int] | None, left: int) -> None:
    """Links members lo to hi, all of one key, with each other or with those of another key, where `left` more bits
    may differ in the last two segments. By the third segment they fall into runs; runs whose third segments
    differ in d bits, d no more than the chain allows, are compared, small ones pair by pair and large ones by
    looking up the last segment with each set of left - d bits changed, so that no run is met in full."""
    low = turned & np.uint64((1 << 2 * WIDTH) - 1)

    def runs(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        third = (low[a:b] >> np.uint64(WIDTH)).astype(np.int64)
        keys, first, sizes = np.unique(third, return_index=True, return_counts=True)
        return keys, first + a, sizes

    keys, first, sizes = runs(lo, hi)
    theirs = runs(*other) if other else (keys, first, sizes)
    for d in range((2 if other is None else 1) + 1):  # of the 2 bits that three segments may differ in, another key takes one
        for flip in _flips(d):
            to = keys ^ flip
            at = np.minimum(np.searchsorted(theirs[0], to), len(theirs[0]) - 1)
            met = theirs[0][at] == to
            if other is None and d:
                met &= to > keys
            a, b = np.flatnonzero(met), at[met]
            pairs = sizes[a] * theirs[2][b]
            few = pairs <= LISTED
            turn = (np.cumsum(pairs[few]) - 1) // AT_ONCE
            x, y = a[few], b[few]
            for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(turn)) + 1):
                _listed(turned, forest, first[x[part]], sizes[x[part]], theirs[1][y[part]], theirs[2][y[part]])
            for i, j in zip(a[~few].tolist(), b[~few].tolist(), strict=True):
                own = turned[first[i] : first[i] + sizes[i]]
                last = turned[theirs[1][j] : theirs[1][j] + theirs[2][j]]
                base = np.uint64(own[0] ^ last[0]) & ~np.uint64((1 << WIDTH) - 1)
                for e in range(left - d + 1):
                    for change in _flips(e):
                        sought = own ^ base ^ np.uint64(change)
                        k = np.minimum(np.searchsorted(last, sought), len(last) - 1)
                        for p in np.flatnonzero(last[k] == sought).tolist():
                            forest.link(int(first[i]) + p, int(theirs[1][j]) + int(k[p]))


@functools.cache
def _flips(n: int) -> list[int]:
    """All sets of n of a segment's bits."""
    return [sum(1 << b for b in bits) for bits in itertools.combinations(range(WIDTH), n)]


def links(fps: DataFrame, col: str = "fp") -> DataFrame:
    """(src long, dst long) between fingerprints that differ in at most three bits: enough links to join
    every component, at most four for each fingerprint. fps: distinct and not null."""
    turns = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("turn"), F.shiftleft(col, WIDTH * k).bitwiseOR(F.shiftrightunsigned(col, (BITS - WIDTH * k) % BITS) if k else F.col(col)).alias("turned")) for k in range(SEGMENTS)]))
    dealt = fps.select(turns.alias("t")).select("t.turn", "t.turned").repartition(partitions(fps.sparkSession), F.col("turn"), F.shiftrightunsigned("turned", BITS - WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(x.column(0)), np.asarray(x.column(1)).view(np.uint64)) for x in batches if x.num_rows]
        if not parts:
            return
        turn, turned = (np.concatenate(x) for x in zip(*parts, strict=True))
        for k in range(SEGMENTS):
            own = np.unique(turned[turn == k])
            if len(own) < 2:
                continue
            roots = ring_links(own)
            moved = np.flatnonzero(roots != np.arange(len(own)))
            back = [((x >> np.uint64(WIDTH * k)) | (x << np.uint64(BITS - WIDTH * k)) if k else x).view(np.int64) for x in (own[moved], own[roots[moved]])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in back], names=["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long")


def components(fps: DataFrame) -> DataFrame:
    """fps: (fp), distinct. (fp, root): which fingerprints are linked, directly or over others."""
    roots = connected_components(links(fps.select("fp")))
    return fps.select("fp").join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), a row for each row of docs.

    Null and empty texts have fingerprint zero and are linked like others; repeated rows stay repeated; a null
    id gets a row and never names a component unless all ids of it are null; an empty table gives no rows.
    Only the id and text columns are read, so others may have any name."""
    of = materialize(fingerprints(docs, id_col, text_col, n), "fingerprints")
    fps = materialize(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = fps.join(components(fps), "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return of.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component left: that of the smallest id (null last), of several such rows that of
    the smallest hash over all columns, of rows that are equal in all columns any one. All columns stay, whatever
    their names; null and empty texts are one component; an empty table gives no rows.

    Only ids, hashes and fingerprints are exchanged. Of the rows themselves, those that a filter of bounded size
    can't rule out to be dropped go to the exact join, and the others nowhere."""
    key, mark, keep, one = free_names(docs, "key", "mark", "keep", "one")
    own = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    of = own.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.col(mark).alias("mark")).alias("row"), F.col(text_col).alias("text"))
    prints = fingerprints(of, "row", "text", kind=of.schema["row"].dataType.simpleString())
    prints = materialize(prints.groupBy(F.col("doc_id").alias("row"), "fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    fps = materialize(prints.groupBy("fp").agg(F.min("row").alias("least")), "distinct")
    named = fps.join(components(fps), "fp")
    first = named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")
    judged = prints.join(first, "fp").select("row", "n", (F.col("row") == F.col("first")).alias("keep")).where("not keep or n > 1")
    judged = materialize(judged.select(F.xxhash64("row.none", "row.id", "row.mark").alias("key"), F.col("row.id").alias("id"), F.col("row.mark").alias("mark"), "keep"), "judged")
    perhaps = maybe_in(judged, "key")
    own = own.withColumn(key, F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(mark)))
    told = judged.select(F.col("key").alias(f"{key}_"), F.col("id").alias(f"{key}_id"), F.col("mark").alias(f"{key}_mark"), F.col("keep").alias(keep))
    exact = (F.col(key) == F.col(f"{key}_")) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{key}_id")) & (F.col(mark) == F.col(f"{key}_mark"))
    met = own.where(perhaps(F.col(key))).join(told, exact, "left").where(F.coalesce(F.col(keep), F.lit(True)))
    # a row that stays and that others equal stands once; rows that the filter let pass for nothing stand each
    met = met.withColumn(one, F.when(F.col(keep).isNotNull(), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())).dropDuplicates([key, mark, one])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return own.where(~perhaps(F.col(key))).select(*columns).unionByName(met.select(*columns))
