"""Systems of definitions, solved from what may be seen: a semi-naive fixed point over rule tables.

A case has definitions ``node = left + right + offset``, where left and right name other
nodes or are the variable (null).  Down from the root the needed nodes are found, each
round from those that are new only; up from the variable the values, each round from
the nodes that were decided in the one before.  A value may be *unknown*: a needed node
that isn't defined or may not be seen is, and so is whatever uses it, at once.  What is
left waiting at the end hangs on itself; it is unknown too.

Rounds go down and up a case's longest chain at most; all cases share them.  The tables
of a round are joined by case and node, so a common node of many cases is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds, union_all

KEY = ["case", "node"]


def needed_nodes(definitions: DataFrame, cases: DataFrame, rounds: Rounds) -> DataFrame:
    """case and node of all that a case's root hangs on, itself included."""
    front = rounds.keep("needed-0", cases.where("root IS NOT NULL").select("case", F.col("root").alias("node")).distinct())
    found, n = [front], 0
    while not front.isEmpty():
        n += 1
        below = front.join(definitions, KEY).select("case", F.explode(F.array("left", "right")).alias("node")).where("node IS NOT NULL").distinct()
        front = rounds.keep(f"needed-{n}", below.join(union_all(found), KEY, "left_anti"))
        found.append(front)
    return union_all(found)


def values(definitions: DataFrame, cases: DataFrame, rounds: Rounds) -> DataFrame:
    """case, node and value (null: unknown) of every needed node.

    definitions: case, node, left, right, offset (long), seen (boolean), a row for each
    case and node; cases: case, root, x (long).
    """
    needed = needed_nodes(definitions, cases, rounds)
    rules = needed.join(definitions, KEY, "left").join(cases.select("case", "x"), "case").withColumn("seen", F.coalesce("seen", F.lit(False)))
    # what a node has without other nodes, and how many of those it waits for
    leaf = lambda side: F.when(F.col(side).isNull(), F.col("x")).otherwise(F.lit(0))
    waits = sum(F.col(side).isNotNull().cast("int") for side in ("left", "right"))
    rules = rounds.keep("rules", rules.select(*KEY, "left", "right", "seen", (F.col("offset") + leaf("left") + leaf("right")).alias("own"), waits.alias("waits")))
    uses = rules.where("seen").select("case", F.col("node").alias("user"), F.explode(F.array("left", "right")).alias("node")).where("node IS NOT NULL")
    ready = rules.where("NOT seen OR waits = 0").select(*KEY, F.when(F.col("seen"), F.col("own")).alias("value"))
    new = rounds.keep("decided-0", ready)
    decided, waiting, n = [new], None, 0
    while not new.isEmpty():
        n += 1
        news = new.join(uses, KEY).select("case", F.col("user").alias("node"), F.col("value").isNull().alias("unknown"), F.coalesce("value", F.lit(0)).alias("part"))
        heard = news.groupBy(*KEY).agg(F.count(F.lit(1)).alias("heard"), F.bool_or("unknown").alias("unknown"), F.sum("part").alias("part"))
        if waiting is not None:
            both = heard.unionByName(waiting.join(heard, KEY, "left_semi"))
            heard = both.groupBy(*KEY).agg(F.sum("heard").alias("heard"), F.bool_or("unknown").alias("unknown"), F.sum("part").alias("part"))
        heard = rounds.keep(f"heard-{n}", heard.join(union_all(decided), KEY, "left_anti"))
        done = heard.join(rules, KEY).where("unknown OR heard = waits").select(*KEY, F.when(~F.col("unknown"), F.col("own") + F.col("part")).alias("value"))
        new = rounds.keep(f"decided-{n}", done)
        decided.append(new)
        open_still = heard.join(new, KEY, "left_anti")
        if waiting is not None:
            open_still = open_still.unionByName(waiting.join(heard, KEY, "left_anti"))
        waiting = rounds.keep(f"waiting-{n}", open_still)
    return needed.join(union_all(decided), KEY, "left").select(*KEY, "value")


def verdicts(definitions: DataFrame, cases: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """case, verdict, value (of the root; null: unknown) and needed (sorted nodes) of every case.

    Both are written first, as every round reads them.
    cases: case, root (null: the variable alone), x, claim, preview.  A previewed case
    passes and needs nothing; else the verdict is FAIL_GAP for an unknown value, PASS if
    it is what is claimed, FAIL_LOGIC if not (or if nothing is claimed).
    """
    rounds = rounds or Rounds(cases.sparkSession, "definitions")
    definitions, cases = rounds.keep("definitions", definitions), rounds.keep("cases", cases)
    asked = cases.where("NOT coalesce(preview, false)")
    every = rounds.keep("values", values(definitions, asked, rounds))
    lists = every.groupBy("case").agg(F.array_sort(F.collect_list("node")).alias("needed"))
    roots = every.withColumnRenamed("node", "root")
    joined = cases.join(lists, "case", "left").join(roots, ["case", "root"], "left")
    shown = F.coalesce("preview", F.lit(False))
    value = F.when(~shown, F.when(F.col("root").isNull(), F.col("x")).otherwise(F.col("value")))
    verdict = F.when(shown, "PASS").when(value.isNull(), "FAIL_GAP").when(value == F.col("claim"), "PASS").otherwise("FAIL_LOGIC")
    none = F.slice("needed", 1, 0)
    return joined.select("case", verdict.alias("verdict"), value.alias("value"), F.coalesce("needed", none, F.array().cast(dict(lists.dtypes)["needed"])).alias("needed"))
