"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round runs on shuffled edges only and writes them to the shared folder, so nothing
is gathered in one place and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _neighbours(edges: DataFrame) -> DataFrame:
    """Of each node u: m, the least of it and its neighbours, and whether it is out of place: not a root with larger neighbours only, nor a leaf of one root."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smaller = F.count_if(F.col("v") < F.col("u"))
    return both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), ((smaller > 1) | (smaller == 1) & (F.count(F.lit(1)) > 1)).alias("moves"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) for every node of the edges (columns a and b) that isn't its own root.

    Loops, repeated and reversed edges don't matter; rows with a null are ignored.  Rounds
    end as soon as each node is a root or a leaf of one root, which the first step of a
    round sees: edges that are such stars already cost that step alone.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u != v")
    e = materialize(e.distinct(), "edges")
    while True:
        # written before the join: of two plain shuffles, unlike of one below an aggregate, a node with very many neighbours can be split
        least = materialize(_neighbours(e), "least")
        if least.where("moves").isEmpty():
            discard(least)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = materialize(up.join(least.drop("moves"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old, large, least)
