"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``edges`` (two long columns ``a, b``); the component is its smallest node.

    Each round is two grouped minima and two joins on a node, all of which Spark can split on hot
    nodes, and ends in a checkpoint.  Rounds grow with the logarithm of the longest path.  Loops and
    repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")
    nodes = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct()
    links = cut(clean.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _signature(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(links)
        if after == before:
            break
        before = after
    return nodes.join(links, nodes["node"] == links["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
