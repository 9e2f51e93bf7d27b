"""Passages chosen by rank, then by the references printed in them, up to a capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds, union_all
from .select import top_k


def follow(passages: DataFrame, ranking: DataFrame, pattern: str, first: int = 2, capacity: int = 4, rounds: Rounds | None = None) -> DataFrame:
    """case, place (from 0), id and how (ranked, referred, filled) of the passages chosen for each case, ``capacity`` at most.

    passages: case, id, text; ranking: case, id, rank.  The list begins with the
    ``first`` best.  Whatever a passage on it refers to (group 1 of ``pattern``) is added
    at its end, in the order of the list and then of the text, if it is a passage of the
    case and not on the list yet; what is still free is filled by rank.

    A round follows the references of the passages that the last one added.  A passage's
    place is that of its first arrival, so each round is one aggregate by passage and
    one top-k by case; a list only grows, so there are at most ``capacity`` rounds.
    References to nothing and in circles add nothing.
    """
    rounds = rounds or Rounds(passages.sparkSession, "references")
    refers = passages.select("case", "id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("nth", "to"))
    refers = rounds.keep("refers", refers.join(passages.select("case", F.col("id").alias("to")), ["case", "to"], "left_semi"))
    # both ends of the list are taken from it: written once, as passages may cost much to make
    ranking = rounds.keep("ranking", ranking.join(passages.select("case", "id"), ["case", "id"], "left_semi"))
    best = top_k(ranking, ["case"], [F.col("rank"), F.col("id")], first, "n")
    new = rounds.keep("chosen-0", best.where(F.col("n") <= capacity).select("case", (F.col("n") - 1).alias("place"), "id"))
    chosen, n = [new], 0
    while not new.isEmpty():
        n += 1
        have = union_all(chosen)
        arrivals = new.join(refers, ["case", "id"]).groupBy("case", F.col("to").alias("id")).agg(F.min(F.struct("place", "nth")).alias("first"))
        arrivals = arrivals.join(have.select("case", "id"), ["case", "id"], "left_anti")
        size = have.groupBy("case").agg(F.count(F.lit(1)).cast("int").alias("size"))
        ranked = top_k(arrivals, ["case"], [F.col("first"), F.col("id")], capacity, "n").join(size, "case")
        new = rounds.keep(f"chosen-{n}", ranked.select("case", (F.col("size") + F.col("n") - 1).alias("place"), "id").where(F.col("place") < capacity))
        chosen.append(new)
    have = chosen[0].withColumn("how", F.lit("ranked"))
    if len(chosen) > 1:
        have = have.unionByName(union_all(chosen[1:]).withColumn("how", F.lit("referred")))
    have = rounds.keep("have", have)
    size = have.groupBy("case").agg(F.count(F.lit(1)).cast("int").alias("size"))
    free = ranking.join(have.select("case", "id"), ["case", "id"], "left_anti")
    filled = top_k(free, ["case"], [F.col("rank"), F.col("id")], capacity, "n").join(size, "case", "left")
    place = F.coalesce("size", F.lit(0)) + F.col("n") - 1
    return have.unionByName(filled.select("case", place.alias("place"), "id", F.lit("filled").alias("how")).where(F.col("place") < capacity))


def complete(passages: DataFrame, chosen: DataFrame) -> DataFrame:
    """case and whether all of its passages were chosen."""
    every = passages.groupBy("case").agg(F.count(F.lit(1)).alias("passages"))
    taken = chosen.groupBy("case").agg(F.count(F.lit(1)).alias("taken"))
    return every.join(taken, "case", "left").select("case", (F.coalesce("taken", F.lit(0)) == F.col("passages")).alias("complete"))
