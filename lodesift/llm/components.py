"""Connected components of a link table, by min-label hooking with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.llm.common import discard, materialize


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links held in memory, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


#: Links of a partition that are contracted at once.
HELD = 1 << 20


def contracted(links: DataFrame) -> DataFrame:
    """links: (u, v). Links that join the same nodes, fewer of them: of each partition, each node's to the least that
    it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []

        def out() -> pa.RecordBatch:
            nodes, least = least_reachable(np.concatenate(u), np.concatenate(v))
            kept = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(least[kept])], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                u.append(np.asarray(batch.column(0)))
                v.append(np.asarray(batch.column(1)))
            if sum(map(len, u)) >= HELD:
                yield out()
                u, v = [], []
        if u:
            yield out()

    return links.mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node long, root long) for each node that has a link; root is the smallest node reachable.

    Null ends and self links are passed over, repeated links count once, no links give no rows. Partitions contract
    their own links first. Each round takes the least label among neighbours, then the label of that label, so
    that rounds grow with the logarithm of the longest shortest path in star-like graphs. Minima are combined
    before each exchange, a hub's links are dealt anew by the engine's skew-join handling, and nothing but a
    count of changed labels comes to the driver."""
    ends = links.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = materialize(contracted(ends).select(ways.alias("way")).select("way.u", "way.v").distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.agg(F.max("moved")).first()[0]:
        of = labels.select("node", "label")
        least = both.join(of, both["v"] == of["node"]).groupBy("u").agg(F.min("label").alias("m"))
        hooked = of.join(least, of["node"] == least["u"]).select("node", "label", F.least("label", "m").alias("next"))
        jump = of.select(F.col("node").alias("at"), F.col("label").alias("on"))
        before, labels = labels, materialize(hooked.join(jump, hooked["next"] == jump["at"]).select("node", F.least("next", "on").alias("label"), (F.least("next", "on") < F.col("label")).alias("moved")), "labels")
        discard(before)
    discard(both)
    return labels.select("node", F.col("label").alias("root"))
