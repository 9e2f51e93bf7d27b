"""Checks of numeric claims, on questions written from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as q
from ..functions.witness import term_pattern
from .registry import Tables, query, spread


def key() -> Column:
    return F.col("p_partkey")


def words(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def cited(rule: str) -> Column:
    """The rule, or another text for every fifth part."""
    return F.array(F.when(key() % 5 == 0, "Nothing is said.").otherwise(f"We read:\n{rule}"))


STATUS = "CASE WHEN p_partkey % 5 = 0 THEN 'REVIEW_REQUIRED' WHEN p_partkey % 2 = 0 THEN 'MATCH_WITHIN_SCOPE' ELSE 'CONTRADICTION' END"


def part(t: Tables, status: Column) -> DataFrame:
    return spread(t.part).select("p_partkey", status.alias("status"))


@query(f"SELECT p_partkey, {STATUS} AS status FROM part")
def rul_12_work(t: Tables) -> DataFrame:
    """Work from a charge and a potential difference."""
    question = words("How much work moves a charge of ", F.col("p_size"), " C across a potential difference of 12.5 V?")
    claim = (F.col("p_size") * F.lit("12.5").cast("decimal(5,1)") + key() % 2).cast("string")
    return part(t, q.work_mapping(question, claim, F.lit("J"), cited("W = V Q (3.2)")))


@query(f"SELECT p_partkey, {STATUS} AS status FROM part")
def rul_13_lens(t: Tables) -> DataFrame:
    """Power of a lens from its focal length."""
    question = words("What is the power of a lens with focal length ", F.col("p_size"), " m?")
    return part(t, q.lens_mapping(question, words("1/", F.col("p_size") + key() % 2), F.lit("dioptres"), cited("P = 1 / f.")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'REVIEW_REQUIRED' WHEN p_partkey % 2 = 0 THEN 'CONDITION_STATED' ELSE 'CONDITION_REQUIRED' END AS status FROM part")
def rul_11_condition(t: Tables) -> DataFrame:
    """Whether an unchanged resistance is stated."""
    stated = F.when(key() % 2 == 0, " Its resistance stays the same.").otherwise("")
    question = words("A heater draws 2 A at ", F.col("p_size"), " V.", stated, " What current does it draw at 7 V?")
    return part(t, q.resistance_condition(question, cited("V = IR")))


@query(f"SELECT p_partkey, {STATUS} AS status FROM part")
def rul_14_heater(t: Tables) -> DataFrame:
    """Current at another voltage: the claim is in mA."""
    size = F.col("p_size")
    question = words("A heater draws 2 A at ", size, " V. Find the current when it is connected to ", size * 3, " V")
    return part(t, q.heater_mapping(question, (6000 + key() % 2).cast("string"), F.lit("mA"), cited("V = I R")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NOT_ASSESSED' WHEN p_partkey % 2 = 0 THEN 'CONSISTENT_WITHIN_SCOPE' ELSE 'CONTRADICTION' END AS status FROM part")
def rul_10_resistance(t: Tables) -> DataFrame:
    """A resistance stated against a voltage and a current."""
    size = F.col("p_size")
    question = words("A conductor is at ", size * 4, " V when it draws 2 A.")
    claim = words("We see that. The resistance is ", size * 2 + key() % 2, " Ω. It is cold.")
    return part(t, q.resistance_consistency(question, F.array(claim, F.lit(None).cast("string")), cited("R = V / I")))


@query("SELECT n_nationkey, n_nationkey % 3 < 2 AS defined FROM nation")
def rul_16_definition(t: Tables) -> DataFrame:
    """Names that a text defines."""
    name = F.lower("n_name")
    texts = F.array(words("The ", name, " means a country."), words("Such a country is called ", name, "."), words("It may be that ", name, " means a country."))
    return t.nation.select("n_nationkey", q.definition_witness(words("the ", F.col("n_name"), " (N)"), F.get(texts, F.col("n_nationkey") % 3)).alias("defined"))


@query(r"SELECT n_nationkey, '(?:(?:the|an|a) )?' || list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: '\Q' || w || '\E'), lambda a, b: a || ' ' || b) AS pattern FROM nation")
def scf_07_name_pattern(t: Tables) -> DataFrame:
    """Patterns for names."""
    return t.nation.select("n_nationkey", term_pattern(words("An  ", F.col("n_name"), " (x)")).alias("pattern"))
