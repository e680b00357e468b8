"""Connected components of a link table by alternating large-star and small-star steps.

Each step maps every link to one with a smaller end, so that components turn into stars around their smallest vertex
in a number of rounds that is logarithmic in practice.  The minimum of a neighbourhood is a partially aggregated
``min``, written to the shared folder; links then join their vertex's minimum in an equi-join of two plain shuffles, whose
large partitions Spark splits, so that a vertex with very many links does not load one task.  Rounds are written as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import scratch


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame, larger: bool) -> scratch.Table:
    """neighbours (a, b): links every chosen b of a to the smallest of a and its neighbours."""
    smallest = neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = scratch.materialize(smallest, "least")
    joined = neighbours.join(least.df, "a")
    out = joined.where(F.col("b") > F.col("a")) if larger else joined
    moved = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.union(least.df.select("a", F.col("m").alias("b")))
    linked = scratch.materialize(moved.where(F.col("a") != F.col("b")).distinct(), "links")
    least.drop()
    return linked


def connected_components(links: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, scratch.Table]:
    """links (a, b), any order and repeats.  Returns (vertex, component) for vertices with a link to another vertex,
    component being the smallest vertex that is reached, and the table behind it."""
    tidy = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = scratch.materialize(tidy, "links"), None
    for _ in range(max_rounds):
        large = _star(_both_ways(now.df), larger=True)
        new = _star(large.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), larger=False)
        large.drop()
        print_ = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        was, is_ = (t.df.agg(F.count(F.lit(1)).alias("n"), print_).first() for t in (now, new))
        now.drop()
        now = new
        if was == is_:
            return now.df.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(
                now.df.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
            ), now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
