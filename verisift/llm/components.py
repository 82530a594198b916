"""Connected components of links, by alternating large-star and small-star steps on DataFrames.

Each step moves links to the smallest neighbour; the number of steps grows with the logarithm of a component's size.
Links never leave the executors: each round is written to the shared folder and only its row count and checksum are
read. A hub's many links are split by adaptive joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable. Nodes without links are not listed; self links do no harm."""
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before or not now[0]:
            break
        before, old = now, edges
        edges = staged(_small_star(_large_star(edges)), "links")
        drop_staged(edges.sparkSession, old.staged_path)
    centres = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(centres)
