"""Connected components by alternating large-star and small-star steps, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlark.llm.common import dropped, written


def connected_components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links(a, b) of any ordered type -> (node, root): each linked node with the smallest node that it reaches.

    Loops and repeated links are harmless; nodes without links do not appear. Each round is written to the
    shared folder. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components"
    )
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("w"), "m", "u")
        pairs = small.select(F.explode(F.array(F.struct(F.col("w").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, edges = edges, written(pairs.select("e.u", "e.v").where("u <> v").distinct(), "components")
        dropped(links.sparkSession, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
