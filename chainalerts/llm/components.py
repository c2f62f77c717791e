"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainalerts.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node that it reaches.

    Alternating large-star and small-star steps: each links the neighbours of a node to their
    least one. They end after about log2 of the diameter rounds, when every node hangs on its
    label. A node's neighbours are never gathered: their minimum is pre-aggregated, and joined
    back by a join whose hot keys Spark can split, as both of its sides are written tables."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        # Large star: larger neighbours hang on the least of a node and its neighbours.
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter(F.col("a") != F.col("b")).distinct(), "edges")
        # Small star: smaller neighbours and the node itself hang on the least of them.
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
        edges = written(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return labels.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
