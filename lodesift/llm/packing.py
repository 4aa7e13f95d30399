"""Conflict-constrained best-fit packing of documents into training sequences.

Rows are dealt to shards by a hash of their id, so that hot sources and groups of copies spread evenly; a
shard holds a bounded number of rows, without their texts. In a shard, open bins stand by what room they have
left, and each carries a bitmap of its sources and one of its duplicate clusters. An item, largest first, goes to
the tightest bin with room whose bitmaps have neither its source nor its cluster.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import word_count

CAPACITY = 1024
SHARD_ROWS = 4096

SCHEMA = "doc_id long, piece int, bin_id long, bin_start int, word_start long, n_words int"


class Bins:
    """Open bins of one shard by room left, then by bitmap of sources."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used = 0
        self.rooms = 0  # bit r is set if a bin has room r left
        self.by_room: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(dict)

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """source, cluster: bits, 0 if there is none. (bin, words in it before)."""
        rooms = self.rooms >> size
        room = size - 1
        while rooms:
            step = (rooms & -rooms).bit_length()
            room, rooms = room + step, rooms >> step
            level = self.by_room[room]
            for sources, bins in level.items():
                if sources & source:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not bins[k][1] & cluster:
                        number, clusters = bins.pop(k)
                        if not bins:
                            del level[sources]
                            if not level:
                                self.rooms &= ~(1 << room)
                        self._open(number, room - size, sources | source, clusters | cluster)
                        return number, self.capacity - room
        number, self.used = self.used, self.used + 1
        self._open(number, self.capacity - size, source, cluster)
        return number, 0

    def _open(self, number: int, room: int, sources: int, clusters: int) -> None:
        if room > 0:
            self.by_room[room].setdefault(sources, []).append((number, clusters))
            self.rooms |= 1 << room


def pack_shard(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """rows: shard, doc_id, source, cluster, size. Places for each piece of each row."""
    out = []
    rows = rows.sort_values(["doc_id", "size", "cluster"], kind="stable", na_position="last").reset_index(drop=True)
    base = int(rows["shard"].iloc[0]) << 32
    bits: dict[tuple[str, object], int] = {}
    shared = rows["cluster"].duplicated(keep=False) & rows["cluster"].notna()
    items = []
    bins = Bins(capacity)
    for i, (doc_id, source, cluster, size, twice) in enumerate(zip(rows["doc_id"], rows["source"], rows["cluster"], rows["size"], shared, strict=True)):
        own = 0 if source is None or source != source else bits.setdefault(("source", source), 1 << len(bits))
        cluster_bit = bits.setdefault(("cluster", cluster), 1 << len(bits)) if twice else 0
        if size == 0:
            out.append((doc_id, 0, None, None, 0, 0))
        for piece, start in enumerate(range(0, size, capacity)):
            items.append((-min(capacity, size - start), i, piece, start, doc_id, own, cluster_bit))
    items.sort()
    for size, _, piece, start, doc_id, source, cluster in items:
        number, at = bins.put(-size, source, cluster)
        out.append((doc_id, piece, base + number, at, start, -size))
    made = pd.DataFrame(out, columns=["doc_id", "piece", "bin_id", "bin_start", "word_start", "n_words"])
    return made.astype({"doc_id": "Int64", "piece": "int32", "bin_id": "Int64", "bin_start": "Int32", "word_start": "int64", "n_words": "int32"})


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, bin_id, bin_start, word_start, n_words): where each piece of each row goes.

    Rows of more than `capacity` words are cut in pieces of that many and a rest. No bin holds two pieces of one
    source or of one duplicate cluster; by default rows with equal lower-cased texts are a cluster. Rows without a
    source conflict with none by it. Null and empty texts get one row with bin_id null and 0 words;
    repeated rows are packed each; rows that tie in size go by id; an empty table gives no rows. Only the id, source and
    text columns are read, so others may have any name."""
    of = F.xxhash64(F.lower(text_col)) if cluster is None else cluster
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), of.alias("cluster"), word_count(F.col(text_col)).alias("size"))
    shards = -(-docs.select(id_col).count() // shard_rows) or 1
    # rows that are equal in all are told apart by where they are read, so that they don't fill one shard
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "cluster", "source", F.spark_partition_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), SCHEMA)
