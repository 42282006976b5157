"""Connected components of an edge table by alternating large and small stars. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Above so many edges the minima are written too, so that both sides of the join are plain shuffles that adaptive execution can split.
WRITTEN = 1_000_000
ROUNDS = 60


def _low(df: DataFrame, big: bool) -> DataFrame:
    low = df.groupBy("u").agg(F.min("v").alias("m"))
    return shared.saved(df.sparkSession, low, "low") if big else low


def _print(df: DataFrame) -> tuple[int, int | None]:
    """Count and an order-free hash: two rounds with the same are taken as equal."""
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (columns a, b of one orderable type); root is the smallest node that can be reached.

    Loops and edges with a null are ignored; an empty table gives an empty table. Each round shuffles the edges
    a few times and writes them to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = shared.saved(spark, now, "edges")
    seen = _print(now)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        big = seen[0] > WRITTEN
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_low(both, big), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = shared.saved(spark, large, "large") if big else large
        met = large.join(_low(large, big), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).distinct()
        now = shared.saved(spark, small, "edges")
        last, seen = seen, _print(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components have not settled in {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
