"""Saved runs, checked against what they were to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_run(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """key and state of every key of either table (key, payload, decision): missing, unexpected, repeated, payload (another one was run), decision (a replay decides otherwise) or ok.

    The first that applies counts.  ``expected`` has each key once; a null key matches none.
    """
    rows = actual.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("payload").alias("ran"), F.max("payload").alias("ran_last"), F.min("decision").alias("decided"), F.max("decision").alias("decided_last"))
    both = expected.withColumn("expected", F.lit(True)).join(rows, "key", "full")
    same = F.col("payload").eqNullSafe(F.col("ran")) & F.col("payload").eqNullSafe(F.col("ran_last"))
    agrees = F.col("decision").eqNullSafe(F.col("decided")) & F.col("decision").eqNullSafe(F.col("decided_last"))
    state = F.when(F.col("times").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("times") > 1, "repeated").when(~same, "payload").when(~agrees, "decision").otherwise("ok")
    return both.select("key", state.alias("state"))
