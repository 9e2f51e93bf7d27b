"""Running sums, ranks and permutations of whole tables, by ranges: no window holds more than one range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import Rounds

#: Steps of a permutation that a number may take outside the range before it lands; each has a chance of at most 3/4.
WALKS = 160


def running(df: DataFrame, order: list[str], weight: Column | None = None, before: str = "before", rounds: Rounds | None = None) -> DataFrame:
    """``df`` with the sum of ``weight`` (1 if none is given) over all rows that come before in ``order``; ``order`` tells any two rows apart.

    Rows are sorted by ranges and written with the number of their range.  The ranges'
    own sums, a row for each, give where a range begins; within it a window counts on.
    """
    rounds = rounds or Rounds(df.sparkSession, "ranges")
    span, own, start = (f"__{name}_{before}" for name in ("range", "own", "start"))
    weighed = df.withColumn(own, (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("long"))
    placed = rounds.keep(f"ranges-{before}", weighed.repartitionByRange(*order).withColumn(span, F.spark_partition_id()))
    sums = placed.groupBy(span).agg(F.sum(own).alias("sum"))
    line = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the sort
    starts = sums.select(span, F.coalesce(F.sum("sum").over(line), F.lit(0)).alias(start))
    inside = Window.partitionBy(span).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn(before, F.sum(own).over(inside) - F.col(own)).join(F.broadcast(starts), span)
    return found.withColumn(before, F.col(before) + F.col(start)).drop(span, own, start)


def until(df: DataFrame, order: list[str], weight: Column, target: int, rounds: Rounds | None = None) -> DataFrame:
    """The first rows in ``order``, up to and with the one at which the sum of ``weight`` reaches ``target``; all rows if none does."""
    return running(df, order, weight, "sum_before", rounds).where(F.col("sum_before") < target).drop("sum_before")


def permuted(number: Column, n: int, seed: str, rounds: int = 6) -> Column:
    """A permutation of 0 to n - 1 that the seed determines, as arithmetic on the number alone: a Feistel network on its two halves.

    The network permutes the numbers below the least power of 4 that isn't below n;
    what falls outside is sent through it again until it lands inside.
    """
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask = (1 << half) - 1

    def network(v: Column) -> Column:
        pair = F.struct(F.shiftright(v, half).alias("l"), v.bitwiseAND(F.lit(mask)).alias("r"))
        keys = F.array(*(F.lit(f"{seed}:{i}") for i in range(rounds)))
        step = lambda p, key: F.struct(p["r"].alias("l"), p["l"].bitwiseXOR(F.xxhash64(p["r"], key).bitwiseAND(F.lit(mask))).alias("r"))
        return F.aggregate(keys, pair, step, lambda p: p["l"] * (mask + 1) + p["r"])

    walk = lambda v, _: F.when(v < n, v).otherwise(network(v))
    landed = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(number.cast("long")), walk)
    return F.when(landed < n, landed).otherwise(F.raise_error(F.lit("a number didn't land inside the range")).cast("long"))


def aliases(df: DataFrame, key: str, seed: str, prefix: str = "P", rounds: Rounds | None = None) -> DataFrame:
    """``df`` with ``alias``: prefix and a number from 1 on, in an order that only the seed knows; every row (``key`` is unique) has its own.

    Rows are numbered by key in ranges, and the numbers permuted.
    """
    rounds = rounds or Rounds(df.sparkSession, "aliases")
    numbered = rounds.keep("numbered", running(df, [key], None, "number_of_row", rounds))
    n = numbered.count()
    alias = F.concat(F.lit(prefix), (permuted(F.col("number_of_row"), n, seed) + 1).cast("string")) if n else F.lit(prefix)
    return numbered.withColumn("alias", alias).drop("number_of_row")
