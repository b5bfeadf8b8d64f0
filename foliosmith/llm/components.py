"""Connected components of a link table, by alternating large-star and small-star rounds over written tables.

Nothing is collected but three counters a round.  Each round's edges and least neighbours are written to the shared folder, so a lost executor costs
no more than a round, and the optimizer knows the sizes of what it joins: small tables of least neighbours are broadcast by their bytes, and where they
are not, both sides of the join come from plain exchanges, so that a node with very many links is split as a skewed key.
Least neighbours themselves are aggregated before the exchange.  Each round at least halves the depth of what is left, so a graph of n nodes
settles in rounds that grow with the logarithm of n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import written


def _state(edges: DataFrame):
    """Count and hashes of a set of edges, whatever their order."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) of every node with a link, root being the smallest id reachable; edges are (a, b) in any order, repeats and loops allowed."""
    a, b = edges.columns[:2]
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    before = _state(now)
    while before[0]:
        # Large star: each node's larger neighbours go to the least of it and its neighbours.
        both = now.select(F.col("u").alias("v"), F.col("v").alias("m")).unionByName(now.select("v", F.col("v").alias("m")))
        large = written(now.join(written(both.groupBy("v").agg(F.min("m").alias("m")), "least"), "v").select("u", F.col("m").alias("v")), "edges")
        # Small star: each node and its smaller neighbours go to the least of them.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        now = written(small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def near_roots(edges: DataFrame) -> DataFrame:
    """(id, root): a smaller or equal id reachable within a few links; equal roots are in one component, others may be too."""
    a, b = edges.columns[:2]
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("root")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("root")))
    first = written(both.groupBy("id").agg(F.least(F.min("root"), F.col("id")).alias("root")), "roots")
    again = first.select(F.col("id").alias("root"), F.col("root").alias("next"))
    return written(first.join(again, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
