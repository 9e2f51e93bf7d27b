"""Evaluation statistics: intervals, cluster bootstrap, summaries with honest denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running
from .rounds import Rounds

Z95 = 1.959963984540054


def share(hits: Column, total: Column) -> Column:
    """hits / total, null where there is nothing to divide by."""
    return F.when(total > 0, hits / total)


def wilson(hits: Column, total: Column, upper: bool, z: float = Z95) -> Column:
    """A bound of the Wilson score interval, within 0 and 1; null for no trials."""
    p = hits / total
    middle = p + z * z / (2 * total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    bound = (middle + half if upper else middle - half) / (1 + z * z / total)
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def drawn(sample: Column, place: Column, n: Column) -> Column:
    """The index, below n, that a sample draws at a place: the first 60 bits of a digest of both."""
    digest = F.md5(F.concat(sample.cast("string"), F.lit(":"), place.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def cluster_bootstrap(values: DataFrame, family: str, value: str, resamples: int = 1000) -> DataFrame:
    """Mean of the families' means, and its 95 % interval by order statistics of resampled families.

    One row: mean, low, high, families.  Families are numbered by name, in ranges.  All
    rows are first reduced to a mean per family; draws are rows of a range, counted by
    sample and number before they meet the means, so neither rows nor families meet at
    the driver.
    """
    spark = values.sparkSession
    rounds = Rounds(spark, "bootstrap")
    means = values.groupBy(family).agg(F.avg(value).alias("m"))
    table = rounds.keep("means", running(means, [family], None, "i", rounds)).select("i", "m")
    n = table.count()
    if not n:
        return spark.createDataFrame([], "mean double, low double, high double, families long")
    count = F.lit(n).cast("long")
    picks = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("sample"), (F.col("id") % n).alias("place"))
    picks = picks.select("sample", drawn(F.col("sample"), F.col("place"), count).alias("i")).groupBy("sample", "i").agg(F.count(F.lit(1)).alias("times"))
    samples = picks.join(table, "i").groupBy("sample").agg((F.sum(F.col("m") * F.col("times")) / n).alias("m"))
    sorted_means = F.sort_array(F.collect_list("m"))  # a number per sample
    cut = round(resamples * 0.025)
    over = samples.agg(F.get(sorted_means, F.lit(cut - 1)).alias("low"), F.get(sorted_means, F.lit(resamples - cut - 1)).alias("high"))
    return table.agg(F.avg("m").alias("mean")).join(F.broadcast(over)).select("mean", "low", "high", count.alias("families"))


def histogram(column: Column, values: list[str]) -> list[Column]:
    """A count column for each value."""
    return [F.count_if(column == v).alias(v.lower()) for v in values]


def set_scores(expected: Column, found: Column) -> tuple[Column, Column, Column]:
    """True positives, false positives and false negatives of two arrays taken as sets."""
    return F.size(F.array_intersect(found, expected)), F.size(F.array_except(found, expected)), F.size(F.array_except(expected, found))
