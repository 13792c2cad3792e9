"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b) with a > b: every node hands its (larger, or smaller and equal)
    neighbours over to the smallest node around it.

    Minima are aggregated before they are joined back, so a node with very many neighbours costs
    one row per task in the aggregation, and its rows in the join can be split (skew join)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, both["a"] == least["n"]).select("a", "b", "m")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots; the root is the
    smallest node of the component. Each round is written; the number of rounds grows with the
    logarithm of the longest path."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen, i = mark(now), 0
    while seen[0]:
        i += 1
        now = materialize(_star(_star(now, True), False), f"stars{i}")
        then, seen = seen, mark(now)
        if then == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
