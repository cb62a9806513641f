"""Connected components of a graph given by its edges, by star contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import join_on_hot, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node of the component.

    Each round ties the larger neighbours of a node, then the smaller ones, to the least node it knows, until all hang on
    the least of their component; the number of rounds follows the logarithm of the longest path. Minima are combined
    before a shuffle, and the edges of a node that has a large part of all meet its minimum by broadcast, so a node with
    very many edges is no hot group."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = join_on_hot(both, least, "a", "n", 2 * mark[0]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large")
        least = settle(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_on_hot(large, least, "a", "n", large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        fresh = _mark(now)
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
