"""Connected components of an edge table by alternating stars.

Large-star links every larger neighbour of a node to the least of its neighbourhood, small-star does so with the
smaller ones; both are an aggregate of minima and a join. After a few rounds each node hangs on the least node
of its component. Edges never leave the executors; each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropgrid.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (columns a, b; null ends and loops are ignored)."""
    now = cut_lineage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = signature(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        now = cut_lineage(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        last, mark = mark, signature(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0)).alias("s")).first()
    return row.n, row.s
