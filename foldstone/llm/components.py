"""Connected components by large-star and small-star rounds, roots of forests by pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.session import materialize, release


def forest_roots(links: DataFrame) -> DataFrame:
    """(node, label) for every u of a forest: ``links`` (u, v: long) has one row for each u, and v < u. The label is the root.

    Each round a node takes the node that its own one points to, so the rounds follow the logarithm of the depth, with one
    table a round.
    """
    at = materialize(links.select(F.col("u").alias("node"), F.col("v").alias("label")), "at")
    while True:
        above = at.select(F.col("node").alias("k"), F.col("label").alias("above"))
        after = at.join(above, F.col("label") == F.col("k"), "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved"))
        after = materialize(after, "at")
        release(at)
        if not after.where("moved").count():
            return after.drop("moved")
        at = after


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long); the label is the component's smallest node.

    Each round links neighbours to the smallest node next to them, until every node is the smallest next to it or has one
    neighbour; the number of rounds follows the logarithm of the nodes. A round's tables are written to the shared folder and
    go with the next round; minima are taken map-side first and written before they are joined, one row a node, so that both
    sides of the join are shuffled for it and a node with many links is split over tasks. No link is collected.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"), "c")
        least = materialize(least, "least")
        if not least.where("m < k and c > 1").count():
            release(pairs)
            return least.select(F.col("k").alias("node"), F.col("m").alias("label"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "large")  # as many rows as ``pairs``; repeated ones go below
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "lowest")
        small = large.join(lowest, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        done, pairs = pairs, materialize(small.where("u <> v").distinct(), "links")
        release(done, least, large, lowest)
