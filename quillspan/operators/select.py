"""Ordered selection: top-k, budgets, round-robin samples, first-wins merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank.

    Spark cuts each task's rows to its own first k before the one exchange, so a group
    of any size sends at most k rows per task.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def first_fit(df: DataFrame, group: list[str], rank: str, size: str, budget: int, most: int | None = None) -> DataFrame:
    """Rows that a greedy budget takes in order of rank: one that doesn't fit is skipped, later ones may fit.

    A fold over each group's (rank, size) pairs alone; meant for ranked short lists.
    """
    pairs = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("r"), F.col(size).cast("long").alias("s")))).alias("__pairs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["s"] <= budget
        if most is not None:
            fits = fits & (F.size(acc["taken"]) < most)
        return F.when(fits, F.struct((acc["used"] + x["s"]).alias("used"), F.array_append(acc["taken"], x["r"]).alias("taken"))).otherwise(acc)

    taken = pairs.select(*group, F.explode(F.aggregate("__pairs", start, step, lambda acc: acc["taken"])).alias(rank))
    return df.join(taken, [*group, rank], "left_semi")


def prefix_fit(df: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The longest run of first rows of each group whose sizes stay within the budget."""
    line = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__used", F.sum(size).over(line)).where(F.col("__used") <= budget).drop("__used")


def round_robin(df: DataFrame, group: str, key: list[Column], n: int) -> DataFrame:
    """n rows dealt from the groups in turn, each group in the order of the key."""
    dealt = top_k(df, [group], key, n, "__turn")
    return dealt.orderBy("__turn", group).limit(n).drop("__turn")


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows of each key the one of least order; all columns travel in one aggregate, so copies meet before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*key, *(F.col("__row")[c].alias(c) for c in rest))


def merge_provenance(df: DataFrame, key: list[str], order: str, provenance: str) -> DataFrame:
    """A row per key with the provenance of all its rows, in order, without repetition."""
    entries = F.array_sort(F.collect_list(F.struct(order, provenance)))
    return df.groupBy(*key).agg(F.array_distinct(F.transform(entries, lambda x: x[provenance])).alias(provenance))
