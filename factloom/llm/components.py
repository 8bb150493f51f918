"""Connected components by alternating large-star and small-star rounds.

All in DataFrame operations; the driver sees one answer a round.  Minima are
pre-aggregated before the shuffle and joined back by a shuffle of their own, so
that a node with very many neighbours is split like any skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_lowest(rows: DataFrame) -> DataFrame:
    """u, v and low, the smallest v of each u."""
    # the second key is no partitioning of the aggregate's, so the join has its own on both sides
    own = F.xxhash64("u").alias("own")
    low = rows.groupBy("u").agg(F.min("v").alias("low")).select("u", own, "low")
    return rows.select("u", "v", own).join(low, ["u", "own"]).select("u", "v", "low")


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of every node of ``edges`` (a, b); the root is the smallest node reached.

    Self-loops and edges with a null end are ignored; repeated edges count once.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = common.materialise(pairs, "edges")
    for _ in range(max_rounds):
        if _settled(pairs):
            break
        both = _with_lowest(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        stars = _with_lowest(large)
        up = stars.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        new = common.materialise(up.unionByName(stars.where("v = low").select("u", "v")).distinct(), "edges")
        common.discard(pairs)
        pairs = new
    else:
        raise RuntimeError("components have not settled")
    # a forest of stars: each node once, under its root
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _settled(pairs: DataFrame) -> bool:
    """Whether every node is a root or stands in one pair, with a root."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()
