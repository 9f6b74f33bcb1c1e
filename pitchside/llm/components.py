"""Distributed union-find: connected components by alternating large and small stars.

Every round hangs nodes under the smallest neighbour they know, so trees flatten in O(log n) rounds.
Neighbour lists are never gathered: a round is a ``min`` aggregate (partial sums first) and an equi-join of
the links with it, whose hot keys adaptive execution splits. Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.sources.stage import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v): root is the smallest node that links reach.

    Self-links only name a node; null ends are left out; no links give no rows.
    """
    named = stage(links.select("u", "v").dropna(), "named-links")
    work = stage(named.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        # Large star: every greater neighbour of a node moves to the least of the node and its neighbours.
        pairs = _both_ways(work)
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        work = stage(small.filter("u <> v").distinct(), "links")
        # Stars: every node hangs under one other, which hangs under none.
        heads = work.select(F.col("u").alias("v")).distinct()
        if work.groupBy("u").count().filter("count > 1").isEmpty() and work.join(heads, "v", "left_semi").isEmpty():
            break
    roots = work.select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = named.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.union(alone.select("node", F.col("node").alias("root")))
