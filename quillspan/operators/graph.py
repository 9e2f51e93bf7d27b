"""Property graphs as node and edge tables: expansion along paths, neighbours, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_back(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Every path of 1 to ``depth`` edges that leads to a start, followed backwards.

    edges: src, dst; starts: start.  One row per path (a node reached by two paths comes
    twice; no edge is used twice in one path): start, node, distance, path_ids from the
    start on.  Restrict the edges to what may be seen before calling this: a hidden node
    then also hides what lies behind it.
    """
    found, front = [], starts.select("start", F.col("start").alias("node"), F.array("start").alias("path_ids"))
    for distance in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("dst"))
        used = F.exists(F.sequence(F.lit(1), F.size("path_ids")), lambda i: (F.get("path_ids", i - 1) == F.col("dst")) & F.coalesce(F.get("path_ids", i) == F.col("src"), F.lit(False)))
        front = step.where(~used).select("start", F.col("src").alias("node"), F.array_append("path_ids", F.col("src")).alias("path_ids"))
        found.append(front.withColumn("distance", F.lit(distance)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("start", "node", "distance", "path_ids")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One hop from the seeds (column id) in either direction: id, neighbour, type, outgoing. A loop comes once."""
    out = edges.join(seeds, F.col("src") == F.col("id"), "inner").select("id", F.col("dst").alias("neighbour"), "type", F.lit(True).alias("outgoing"))
    back = edges.where("src != dst").join(seeds, F.col("dst") == F.col("id")).select("id", F.col("src").alias("neighbour"), "type", F.lit(False).alias("outgoing"))
    return out.unionByName(back)


def coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes (column id), counted by type."""
    kept = edges.join(nodes, F.col("src") == F.col("id"), "left_semi").join(nodes, F.col("dst") == F.col("id"), "left_semi")
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    return old.join(new, key, "left_anti").unionByName(new)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends exist among the nodes (column id)."""
    return edges.join(nodes, F.col("src") == F.col("id"), "left_semi").join(nodes, F.col("dst") == F.col("id"), "left_semi").distinct()
