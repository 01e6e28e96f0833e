"""Connected components of an undirected graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_counted


def components(edges: DataFrame, work: Workspace, table: str) -> DataFrame:
    """node and root (the smallest node of its component) of the nodes of `edges` (a, b: long), as a table of `work`.

    Alternating stars: every node points its larger neighbours at its smallest one, then its smaller neighbours, until
    each component is a star around its root. Each round sums by node and joins by node; the longest path shrinks by
    half or more, and no component is ever gathered in one place.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = work.save(pairs, f"{table}-0")
    before, k = _state(pairs), 0
    while before[0]:
        k += 1
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, before[0], True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = work.save(large, f"{table}-large")
        joined = _with_least(large, before[0], False)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b")
        pairs = work.save(small.distinct(), f"{table}-{k}")
        work.drop(f"{table}-large", f"{table}-{k - 1}")
        now = _state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = work.save(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), table)
    work.drop(f"{table}-{k}")
    return out


def _with_least(pairs: DataFrame, n: int, itself: bool) -> DataFrame:
    """a, b and m: the least neighbour of a, or a itself."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.withColumn("m", F.least("a", "m")) if itself else least
    return join_counted(pairs, least, "a", n)


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
