"""Connected components of an edge table by alternating stars, written down after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import staged


def _stars(pairs: DataFrame, neighbours: DataFrame, keep) -> DataFrame:
    """Links every neighbour to the least node among a node and its neighbours."""
    least = neighbours.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    return keep(pairs.join(least, "node")).where("node > other").select("node", "other")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of `edges` (a, b long): root is the smallest node it can reach.

    Rounds link each node to the least one around it, first from larger neighbours, then from smaller
    ones, until nothing changes; their number grows with the logarithm of the longest path. Hot
    nodes are pre-aggregated, and their rows in the join are plain rows that Spark may split. Edges
    with a null or with equal ends are passed over.
    """
    now = staged(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _stars(
            both, both, lambda j: j.where("other > node").select(F.col("other").alias("node"), F.col("low").alias("other"))
        ).distinct()
        large = staged(large)
        small = _stars(
            large,
            large,
            lambda j: j.select(F.explode(F.array("node", "other")).alias("node"), F.col("low").alias("other")),
        ).distinct()
        now = staged(small)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select("node", F.col("other").alias("root"))
    return roots.unionByName(now.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; equal tables have equal ones."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
