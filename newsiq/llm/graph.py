"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsiq.llm.batches import cut


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable from each end of ``edges`` (a, b).

    Alternating large-star and small-star steps.  Every round links a node's
    neighbours to the smallest of them, so the number of edges does not grow
    and chains shrink geometrically; neighbours are never listed, only their
    minimum is taken, which is combined before the shuffle.  A hub's edges meet
    its one minimum in a join that the adaptive planner can split.  Every
    round is written to the shared folder.
    """

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Every node has one link, and none leads to a node that has a link itself."""
        tails = e.groupBy("a").agg(F.count("*").alias("n"))
        several = tails.where("n > 1").select(F.lit(1).alias("x"))
        onward = e.select(F.col("b").alias("a")).join(tails.select("a"), "a", "left_semi").select(F.lit(1).alias("x"))
        return several.unionAll(onward).isEmpty()

    e = cut(pairs(edges))
    for _ in range(max_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(pairs(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(pairs(small.unionByName(low.select("a", F.col("m").alias("b")))))
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    hubs = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cut(stars.unionByName(hubs))
