"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze


def _smallest(links: DataFrame, node: str, other: str) -> DataFrame:
    """The smallest neighbour of each node, itself included; written, so that a node with very many
    links meets the next join as a plain shuffle that can be split."""
    return freeze(links.groupBy(F.col(node).alias("node")).agg(F.least(F.min(other), F.first(node)).alias("least")), "stars")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> ``node``, ``component``: the smallest node reachable, for every node that has a link.

    Large and small star contractions in turn, until nothing changes: a logarithmic number of
    rounds, each a shuffle of the links, which never grow in number. Only counts come to the
    driver. A link of a node to itself says nothing; repeated links count once. No links: no rows.
    """
    stars = freeze(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both, "u", "v")
        large = both.join(least, both["u"] == least["node"]).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = freeze(large.distinct(), "links")
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        least = _smallest(large, "u", "v")
        small = large.join(least, large["u"] == least["node"]).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        stars = freeze(small.unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v"))).distinct(), "links")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sign:
            break
        sign = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
