"""Connected components by alternating large and small stars.

Every round replaces the edges by fewer hops to smaller nodes, in joins and
aggregates; rounds grow with the logarithm of the longest chain.  Each round is
written to the shared folder, so lost executors cost one round at most.  A
node's neighbourhood never meets in one task: minima are pre-aggregated, and
joined back to the edges, where the planner can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, saved


def _least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _digest(edges: DataFrame) -> tuple:
    """The number of distinct edges and two 64-bit sums over them: what stays equal when nothing moves."""
    first, second = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(edges.agg(F.count("*"), F.bit_xor(first), F.bit_xor(second)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (two columns of one orderable type)
    with the smallest node of its component; roots themselves included."""
    a, b = edges.columns
    now = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the smallest node around
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        then = saved(small)
        drop(now)
        now, before, seen = then, seen, _digest(then)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
