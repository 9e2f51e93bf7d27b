"""Guards in a row: each decides only rows that none before it has decided, and its name stays with the row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import let
from .rounds import Rounds, union_all


@dataclass(frozen=True)
class Stage:
    """Guards over the same columns: name and status of each, where null lets a row pass. ``prepare`` brings the columns, for rows that are open still."""

    name: str
    guards: tuple[tuple[str, Column], ...]
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df


def decide(rows: DataFrame, stages: list[Stage], passed: Column, rounds: Rounds | None = None) -> DataFrame:
    """``rows`` with status and guard; rows that pass every guard have the status ``passed`` and the guard ``none``.

    A stage is computed once, for open rows only, and written; a guard of it isn't
    evaluated for a row that an earlier one decides.  Each row has one status, so the
    counts by guard add up to the rows.
    """
    rounds = rounds or Rounds(rows.sparkSession, "cascade")
    keep = rows.columns
    still, closed = rows, []
    for stage in stages:
        named = lambda name, status: let(status, lambda s: F.when(s.isNotNull(), F.struct(s.alias("status"), F.lit(name).alias("guard"))))
        verdict = F.coalesce(*(named(name, status) for name, status in stage.guards))
        done = rounds.keep(stage.name, stage.prepare(still).withColumn("__verdict", verdict))
        closed.append(done.where("__verdict IS NOT NULL").select(*keep, "__verdict.status", "__verdict.guard"))
        still = done.where("__verdict IS NULL").drop("__verdict")
    return union_all([*closed, still.select(*keep, passed.alias("status"), F.lit("none").alias("guard"))])


def counts(decided: DataFrame) -> DataFrame:
    """guard, status and n."""
    return decided.groupBy("guard", "status").agg(F.count(F.lit(1)).alias("n"))
