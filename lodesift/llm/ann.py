"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards by a hash of their id; each shard keeps distinct vectors once. Its graph is built
by batches: a greedy search of the graph so far proposes neighbours, and pruning with a relaxed distance keeps a
diverse few, in both directions. A constant is added as one more component so that all vectors of a shard have
one length: the nearest in the graph then have the largest inner product. A query is answered by a beam search
of every shard; what the beams find is scored exactly, in double precision, and merged. How wide a shard's beams
are follows from its vectors: they double until the recall of a bounded sample of them reaches RECALL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm.common import materialize

DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
#: Vectors of a shard, about, and shards at least.
SHARD = 32_768
SHARDS = 8
#: Queries that meet a shard in one task.
BLOCK = 65_536
#: What beams must find, on average, of the nearest to CHECKED vectors of a shard; these are compared with all.
RECALL = 0.95
CHECKED = 128
#: A search expands a WIDE-th of its beam at once; so many searches run at once, fewer where beams are wider.
WIDE = 32
AT_ONCE = 256
#: Starts of searches, as multiples of the root of a shard's nodes: vectors by chance, and the longest ones.
SPREAD = 4
LONGEST = 1


class Graph:
    """nodes: n x d float32; out: n x DEGREE int32 (more once all are reachable), -1 where there is no edge; starts:
    where searches begin."""

    def __init__(self, nodes: np.ndarray, out: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.nodes = nodes
        self.out = np.full((len(nodes), DEGREE), -1, np.int32) if out is None else out
        self.starts = np.array([((nodes - nodes.mean(axis=0)) ** 2).sum(axis=1).argmin()], np.int32) if starts is None else starts

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that greedy searches hold in the end, nearest first, and their squared distances; -1 and
        infinity where there are fewer."""
        m, wide = len(queries), max(1, beam // WIDE)
        ids = np.full((m, beam), -1, np.int32)
        far = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, len(self.nodes)), bool)
        seen[:, self.starts] = True
        at = self.nodes[self.starts]
        gap = (queries**2).sum(axis=1)[:, None] + (at**2).sum(axis=1) - 2 * (queries @ at.T)
        order = np.argsort(gap, axis=1, kind="stable")[:, :beam]
        n = order.shape[1]
        ids[:, :n], far[:, :n], done[:, :n] = self.starts[order], np.take_along_axis(gap, order, axis=1), False
        live = np.arange(m)
        while len(live):
            pick = np.argsort(done[live], axis=1, kind="stable")[:, :wide]
            at = ids[live[:, None], pick]
            fresh = ~done[live[:, None], pick]
            done[live[:, None], pick] = True
            near = np.where(fresh[:, :, None], self.out[at], -1).reshape(len(live), -1)
            near = np.where((near >= 0) & ~seen[live[:, None], near], near, -1)
            order = np.sort(near, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            near = order
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            gap = self.nodes[near[r, c]] - queries[live[r]]
            d[r, c] = np.einsum("ij,ij->i", gap, gap)
            all_ids, all_far = np.concatenate([ids[live], near], axis=1), np.concatenate([far[live], d], axis=1)
            all_done = np.concatenate([done[live], near < 0], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            k = np.arange(len(live))[:, None]
            ids[live], far[live], done[live] = all_ids[k, best], all_far[k, best], all_done[k, best]
            live = live[~done[live].all(axis=1)]
        return ids, far

    def prune(self, points: np.ndarray, candidates: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
        """points: m node numbers; candidates: m x c, -1 for none. At most DEGREE of each row's: the nearest, then
        again the nearest of those that aren't nearer to a kept one, by a factor alpha, than to the point."""
        cand = np.sort(candidates, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == points[:, None]] = -1
        gap = self.nodes[cand] - self.nodes[points][:, None, :]
        d = np.where(cand >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        k = np.arange(len(points))[:, None]
        cand, d = cand[k, order], d[k, order]
        at = self.nodes[cand]
        square = np.einsum("ijk,ijk->ij", at, at)
        kept = np.full((len(points), DEGREE), -1, np.int32)
        alive = np.isfinite(d)
        row = np.arange(len(points))
        for i in range(DEGREE):
            if not alive.any():
                break
            first = alive.argmax(axis=1)
            some = alive[row, first]
            chosen = cand[row, first]
            kept[some, i] = chosen[some]
            dots = np.matmul(at, at[row, first][:, :, None])[:, :, 0]
            between = square + square[row, first][:, None] - 2 * dots
            alive &= (alpha * alpha * between > d) & some[:, None]
            alive[row, first] = False
        return kept

    def insert(self, batch: np.ndarray) -> None:
        found, _ = self.search(self.nodes[batch], BUILD_BEAM)
        self.out[batch] = self.prune(batch, np.concatenate([found, self.out[batch]], axis=1))
        src, dst = np.repeat(batch, DEGREE), self.out[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = 1 << np.ceil(np.log2(count)).astype(int)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            new = np.full((len(of), w), -1, np.int32)
            nth = np.arange(w)[None, :]
            has = nth < count[of][:, None]
            new[has] = src[(first[of][:, None] + nth)[has]]
            step = max(1, (AT_ONCE * 128) // (w + DEGREE))
            for lo in range(0, len(of), step):
                t = targets[of[lo : lo + step]]
                both = np.concatenate([self.out[t], new[lo : lo + step]], axis=1)
                room = (both >= 0).sum(axis=1) <= DEGREE
                packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :DEGREE]
                if not room.all():
                    packed[~room] = self.prune(t[~room], both[~room])
                # an edge may have been there already
                dup = np.sort(packed, axis=1)
                dup[:, 1:][dup[:, 1:] == dup[:, :-1]] = -1
                self.out[t] = dup

    def connect(self) -> None:
        """Adds an edge to each node that no path from the start leads to, from the nearest that can be reached."""
        while True:
            seen = np.zeros(len(self.nodes), bool)
            level = self.starts
            while len(level):
                seen[level] = True
                level = np.unique(self.out[level])
                level = level[level >= 0]
                level = level[~seen[level]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            more: list[tuple[int, int]] = []
            for lo in range(0, len(lost), AT_ONCE):
                part = lost[lo : lo + AT_ONCE]
                near, _ = self.search(self.nodes[part], 1)
                more += zip(near[:, 0].tolist(), part.tolist(), strict=True)
            src, dst = np.array(more, np.int64).T
            order = np.argsort(src, kind="stable")
            src, dst = src[order], dst[order]
            nth = np.arange(len(src)) - np.searchsorted(src, src)
            wide = np.full((len(self.nodes), int(nth.max()) + 1), -1, np.int32)
            wide[src, nth] = dst
            self.out = np.concatenate([self.out, wide], axis=1)


    def products(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The nodes that beams hold for queries without the last component."""
        step = max(16, AT_ONCE * SEARCH_BEAM // beam)
        wide = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        return np.concatenate([self.search(wide[lo : lo + step], beam)[0] for lo in range(0, len(wide), step)])

    def beam(self, k: int) -> int:
        """The beam, doubled from SEARCH_BEAM on, at which the sample's recall of the k largest products reaches
        RECALL; at most the graph's size, where a search meets all nodes."""
        n = len(self.nodes)
        k = min(k, n)
        # not the vectors where searches begin, which are found sooner than others
        others = np.setdiff1d(np.arange(n), self.starts)
        sample = np.random.default_rng([n, k]).permutation(others if len(others) >= k else n)[:CHECKED]
        sample = self.nodes[sample, :-1].astype(np.float64)
        score = sample @ self.nodes[:, :-1].T.astype(np.float64)
        least = np.partition(score, n - k, axis=1)[:, n - k]
        beam = max(SEARCH_BEAM, 2 * k)
        while beam < n:
            hits = self.products(sample, beam)
            found = np.where(hits >= 0, np.take_along_axis(score, np.maximum(hits, 0), axis=1), -np.inf)
            if np.minimum((found >= least[:, None]).sum(axis=1) / k, 1).mean() >= RECALL:
                break
            beam = min(2 * beam, n)
        return beam


def build(nodes: np.ndarray) -> Graph:
    """A graph over vectors with one more component that makes all lengths equal."""
    norm = (nodes.astype(np.float64) ** 2).sum(axis=1)
    graph = Graph(np.concatenate([nodes, np.sqrt(norm.max() - norm)[:, None]], axis=1).astype(np.float32))
    order = np.random.default_rng(len(nodes)).permutation(len(nodes)).astype(np.int64)
    # a search that begins in one place doesn't leave its cluster, and products are large where vectors are long
    root = math.ceil(math.sqrt(len(nodes)))
    longest = np.argsort(-norm, kind="stable")[: LONGEST * root]
    graph.starts = np.unique(np.concatenate([graph.starts, longest, order[: SPREAD * root]])).astype(np.int32)
    order = np.concatenate([graph.starts, order[~np.isin(order, graph.starts)]]).astype(np.int64)
    at = 0
    while at < len(order):
        n = min(AT_ONCE, at + 1)
        graph.insert(order[at : at + n])
        at += n
    graph.connect()
    return graph


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, component after component."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets the SQL condition is_query over the id, the k
    rows of largest inner product found among all with another id, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id.
    Vectors are only compared with those of their own length. Equal vectors are one node whose ids all count;
    repeated rows with one id and vector count once; where one id has several vectors, all are candidates for
    others and the least of them, component by component, is the query. With fewer candidates than k all are
    returned; an empty table gives no rows; other columns, whatever their names, aren't read. The index holds every
    row; a graph's own recall of the k largest products, measured on CHECKED of its vectors, is RECALL or more."""
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null")
    usable = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = chosen.where(F.coalesce(usable, F.lit(False))).withColumn("dim", F.size("v"))
    shards = usable.groupBy("dim").agg(F.greatest(F.lit(SHARDS).cast("long"), F.ceil(F.count(F.lit(1)) / SHARD)).alias("shards"))
    shards = materialize(shards, "shards")
    usable = usable.join(shards, "dim")

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids, v = np.asarray(table["vec_id"]), _matrix(table["v"], dim)
        order = np.lexsort((ids,))
        ids, v = ids[order], v[order] + 0.0
        _, first, back = np.unique(np.ascontiguousarray(v).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        graph = build(v[first].astype(np.float32))
        by = np.lexsort((ids, back))
        again = np.zeros(len(by), bool)
        again[1:] = (ids[by][1:] == ids[by][:-1]) & (back[by][1:] == back[by][:-1])
        by = by[~again]
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [key[1].as_py()], "ids": [ids[by].tobytes()], "of": [back[by].astype(np.int32).tobytes()], "nodes": [v[first].tobytes()], "out": [graph.out.tobytes()], "starts": [graph.starts.astype(np.int32).tobytes()], "beam": pa.array([graph.beam(k)], pa.int32())})

    index = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards"))).groupBy("dim", "shard").applyInArrow(fit, "dim int, shard long, ids binary, of binary, nodes binary, out binary, starts binary, beam int")
    index = materialize(index, "graphs")
    queries = usable.where(F.expr(is_query)).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "shards")).alias("q")).select("vec_id", "q.*")
    blocks = max(1, -(-queries.count() // BLOCK))

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": [key[1].as_py()], "shards": [table["shards"][0].as_py()], "names": [np.asarray(table["vec_id"]).astype(np.int64).tobytes()], "q": [_matrix(table["v"], dim).tobytes()]})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _found(row, k)

    blocked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)))
    blocked = blocked.groupBy("dim", "block").applyInArrow(packed, "dim int, block long, shards long, names binary, q binary")
    # a block of queries is one row that meets each shard; no query is a row of its own there
    asked = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    found = index.join(asked, ["dim", "shard"]).mapInArrow(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(row: dict, k: int) -> Iterator[pa.RecordBatch]:
    """What the beams of a block of queries find in one shard."""
    dim = row["dim"]
    nodes = np.frombuffer(row["nodes"], np.float64).reshape(-1, dim)
    ids, of = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["of"], np.int32)
    norm = (nodes**2).sum(axis=1)
    graph = Graph(np.concatenate([nodes, np.sqrt(norm.max() - norm)[:, None]], axis=1).astype(np.float32), np.frombuffer(row["out"], np.int32).reshape(len(nodes), -1), np.frombuffer(row["starts"], np.int32))
    first = np.searchsorted(of, np.arange(len(nodes)))
    count = np.diff(np.append(first, len(of)))
    names, q = np.frombuffer(row["names"], np.int64), np.frombuffer(row["q"], np.float64).reshape(-1, dim)
    for lo in range(0, len(names), AT_ONCE):
        part, name = q[lo : lo + AT_ONCE], names[lo : lo + AT_ONCE]
        hits = graph.products(part, row["beam"])
        r, c = np.nonzero(hits >= 0)
        node = hits[r, c]
        score = inner(part[r], nodes[node])
        # of equal vectors the first k + 1 ids are enough
        n = np.minimum(count[node], k + 1)
        rep = np.repeat(np.arange(len(node)), n)
        who = ids[first[node][rep] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        r, score = r[rep], score[rep]
        other = who != name[r]
        r, who, score = r[other], who[other], score[other]
        order = np.lexsort((who, -score, r))
        r, who, score = r[order], who[order], score[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        yield pa.RecordBatch.from_arrays([pa.array(x[nth < k]) for x in (name[r], who, score)], names=["query_id", "vec_id", "score"])
