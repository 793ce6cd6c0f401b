"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, checkpointed

_EDGE = "node long, root long"


def _contract(batches):
    """Star edges (node, smallest node) of the components that one partition's links form.

    A slice of links is contracted at a time, so memory is bounded whatever the partition's size.
    """
    for b in batches:
        node, root = b.column(0).to_numpy(), b.column(1).to_numpy()
        names, flat = np.unique(np.concatenate([node, root]), return_inverse=True)
        label = np.arange(len(names))
        a, c = flat[: len(node)], flat[len(node) :]
        while True:
            least = np.minimum(label[a], label[c])
            old = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, c, least)
            np.minimum.at(label, old[a], least)
            np.minimum.at(label, old[c], least)
            label = label[label]
            if np.array_equal(old, label):
                break
        kept = np.flatnonzero(label != np.arange(len(names)))
        yield batch(node=pa.array(names[kept], pa.int64()), root=pa.array(names[label[kept]], pa.int64()))


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for each node of a link, root the smallest node reachable; roots map to themselves.

    ``links`` holds two long columns; nulls and self links are ignored, an empty table gives an empty
    one. No node's neighbours are gathered: minima are pre-aggregated and joined back to the links. They
    are materialised first, so that both sides of the join are read as they are and a hub's links can be
    split over tasks. Each round is checkpointed.
    """
    edges = links.select(F.col(left).cast("long").alias("node"), F.col(right).cast("long").alias("root"))
    edges = checkpointed(edges.where("node <> root").mapInArrow(_contract, _EDGE))
    state = None
    while True:
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = checkpointed(both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("least")))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        large = large.where("node <> root").union(least.where("least < node").select("node", F.col("least").alias("root")))
        down = checkpointed(large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct())
        least = checkpointed(down.groupBy("node").agg(F.min("root").alias("least")))
        small = down.join(least, "node").select(F.explode(F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("e"))
        edges = checkpointed(small.select("e.node", "e.root").where("node <> root").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if state == tuple(now) or now[0] == 0:
            break
        state = tuple(now)
    roots = edges.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.union(roots)
