"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join on the node, so a hub node with a
third of all edges is pre-aggregated, and its rows in the join can be split by
Spark. Each round's edges are written to the shared folder (lineage is cut, a
lost executor is survived); only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it sees."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    Null ends and loops are ignored, repeated edges count once. An empty table
    gives an empty result. More than ``max_rounds`` rounds (never seen; the
    number grows with the logarithm of the longest path) raise an error.
    """
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(start.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        now = materialise(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
