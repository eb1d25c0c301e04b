"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its smallest node.

    Each round is two grouped minima and two equi-joins over at most as many rows as there are edges; the
    number of rounds grows with the logarithm of the longest path. Nodes without a link are not returned.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != seen:
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined, so that the links of a star's centre can be split among tasks
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select("v", "m").toDF("u", "v")
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    # what remains are stars: no centre is a leaf
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", "v").toDF("node", "component").distinct())
