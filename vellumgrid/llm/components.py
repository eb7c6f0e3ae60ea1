"""Connected components of a link table by label propagation with pointer jumping.

Every round takes the smallest label among a node's neighbours, then follows the label
once, so that path lengths shrink geometrically.  Each round is materialised in the
shared folder.  Links are contracted first, so that a group whose members were linked in many
buckets costs about one link a member.  Nothing is collected; labels of a hub are pre-aggregated map-side,
and the few nodes with a large share of the links, or roots with a large share of the nodes, are joined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_by, spread_join


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> node, root (the smallest node reachable), for every
    node in a link.  Self-links and repeated links are harmless, nulls are left out."""
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # contract: each node keeps its smallest partner, to which its other partners move
    moved = spread_join(links, links.groupBy("b").agg(F.min("a").alias("m")), "b")
    moved = moved.select("m", F.explode(F.array("a", "b")).alias("b")).where(F.col("m") != F.col("b")).withColumnRenamed("m", "a").unionByName(links.where(F.col("a") == F.col("b")))
    moved = cut(moved.distinct())  # it is read in both directions
    pairs = cut(moved.unionByName(moved.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    hubs = hot_keys(pairs, "b")  # the same in all rounds
    while True:
        near = join_by(pairs, labels.withColumnsRenamed({"node": "b", "root": "r"}), "b", hubs).groupBy("a").agg(F.min("r").alias("r"))
        lower = cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("to")))
        new = cut(spread_join(lower, labels.withColumnsRenamed({"node": "to", "root": "far"}), "to").select("node", "old", F.least("to", "far").alias("root")))
        labels = new.select("node", "root")
        if not new.where(F.col("root") != F.col("old")).limit(1).count():
            return labels
