"""Corruption controls: cases with one thing spoilt, and a packet of them that shows neither what nor which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import aliases
from .rounds import Rounds

#: What is spoilt, and what should come of it.
OPERATORS = {"clean": "answer", "missing_rule": "withhold", "damaged_symbol": "withhold", "wrong_unit": "withhold"}
DAMAGED = "[unreadable symbol]"


def corruption_cases(items: DataFrame) -> DataFrame:
    """Four cases of each item: id (item and operator), item, operator, question, source, expected and spoilt (whether the operator changed anything).

    items: item (unique), question, source, rule and symbol (texts within the source),
    unit (within the question) and other_unit.  Only the first place of each is spoilt.
    """

    def first(text: Column, old: Column, new: Column) -> Column:
        at = F.when(F.coalesce(old, F.lit("")) != "", F.instr(text, old)).otherwise(F.lit(0))
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)

    def case(operator: str) -> Column:
        question, source = F.col("question"), F.col("source")
        q = first(question, F.col("unit"), F.col("other_unit")) if operator == "wrong_unit" else question
        s = first(source, F.col("rule"), F.lit("")) if operator == "missing_rule" else first(source, F.col("symbol"), F.lit(DAMAGED)) if operator == "damaged_symbol" else source
        return F.struct(F.lit(operator).alias("operator"), q.alias("question"), s.alias("source"), F.lit(OPERATORS[operator]).alias("expected"), ((q != question) | (s != source)).alias("spoilt"))

    rows = items.select("item", F.explode(F.array(*map(case, OPERATORS))).alias("c"))
    return rows.select(F.concat_ws("_", F.col("item").cast("string"), "c.operator").alias("id"), "item", "c.*")


def blinded(cases: DataFrame, seed: str, rounds: Rounds | None = None) -> tuple[DataFrame, DataFrame]:
    """The packet (alias, question, source) and its key (alias, id): every case once, under a number that tells nothing of it."""
    rounds = rounds or Rounds(cases.sparkSession, "blinded")
    named = rounds.keep("named", aliases(cases, "id", seed, "R", rounds))
    return named.select("alias", "question", "source"), named.select("alias", "id")
