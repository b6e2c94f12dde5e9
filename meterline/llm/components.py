"""Connected components of an edge table by alternating star contraction.

Each round points every node at the smallest neighbour (large star), then
points smaller neighbours and the node itself at their minimum (small star).
Both are a partially aggregated ``min`` plus an equi-join whose other side
may be split by AQE, so a node with very many edges never meets in one task.
Rounds are written to the shared folder; only two sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterline.llm.common import drop_stored, stored


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                     F.bit_xor(F.xxhash64("v", "u"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of
    its component.  Self-loops and null ends are ignored; repeated edges count
    once.  An empty edge table gives an empty result."""
    cur = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc")
    before = _state(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = stored(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        nxt = stored(small, "cc")
        after = _state(nxt)
        drop_stored(cur)
        drop_stored(large)
        cur = nxt
        if after == before:
            break
        before = after
    pairs = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
