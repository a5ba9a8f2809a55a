"""Connected components of a graph of long ids, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` with one node of its component. Loops and repeated edges do no harm.

    The star of a node is never gathered: its least neighbour comes from a pre-aggregated minimum that is joined back, so that
    a node with very many neighbours is spread by the skew handling of the join. Each round is written to the shared folder.
    """
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    for _ in range(max_rounds):
        # large star: neighbours above a node are linked to its least neighbour (or to itself)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, are linked to its least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "components")
        # every node linked once, and no root linked further: stars
        deep = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x"))
        chained = after.select("v").join(after.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x"))
        now = after
        if not deep.unionByName(chained).take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
