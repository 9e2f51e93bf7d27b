"""Exact kernels over table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import udfs
from ..functions.scope import contains_any
from ..functions.textfn import LITERAL, literals
from ..functions.witness import relation_witness
from ..operators import corpus
from .registry import Tables, query

whole = lambda c: F.col(c).cast("long").cast("string")


@query("SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * l_linenumber - l_suppkey)::VARCHAR AS result, l_quantity::BIGINT * l_linenumber - l_suppkey = 25 AS consistent FROM lineitem")
def rul_01_exact_calc(t: Tables) -> DataFrame:
    """Exact arithmetic on expressions in a column, and whether a claim holds."""
    expression = F.concat(whole("l_quantity"), F.lit(" * ("), whole("l_linenumber"), F.lit(") - "), whole("l_suppkey"))
    r = t.lineitem.select("l_orderkey", "l_linenumber", udfs()["exact_calc"](expression, F.lit("50/2")).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "r.result", "r.consistent")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_partkey * 7)::BIGINT % p_size = 0 END AS divides FROM part".replace("(p_partkey * 7)::BIGINT % p_size = 0", "(p_partkey // (p_size % 7)) * (p_size % 7) = p_partkey"))
def rul_02_division(t: Tables) -> DataFrame:
    """Division is exact: quotient times divisor gives the dividend only for whole quotients; by zero it is refused."""
    d = F.pmod("p_size", F.lit(7))
    q = F.expr("p_partkey div nullif(p_size % 7, 0)")
    r = udfs()["exact_calc"](F.concat(whole("p_partkey"), F.lit(" / "), d.cast("string")), F.coalesce(q.cast("string"), F.lit("0")))
    return t.part.select("p_partkey", r["consistent"].alias("divides"))


@query("SELECT doc_id, CASE WHEN quality = toxic THEN CASE WHEN quality = 1 THEN 'PASS' ELSE 'ABSTAIN' END WHEN toxic = 1 THEN 'FAIL_LOGIC' ELSE 'FAIL_GAP' END AS verdict FROM labels")
def rul_03_decision(t: Tables) -> DataFrame:
    """A verdict from two findings."""
    same = F.when(F.col("quality") == 1, "PASS").otherwise("ABSTAIN")
    return t.labels.select("doc_id", F.when(F.col("quality") == F.col("toxic"), same).when(F.col("toxic") == 1, "FAIL_LOGIC").otherwise("FAIL_GAP").alias("verdict"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'FAIL_GAP' WHEN p_partkey % 2 = 0 THEN 'PASS' ELSE 'FAIL_LOGIC' END AS status,
  CASE WHEN p_size % 5 = 0 THEN ['P1'] ELSE ['P1', 'P2'] END AS needed FROM part""")
def rul_04_source_analysis(t: Tables) -> DataFrame:
    """An equality checked through definitions given by earlier passages; some miss one."""
    size, key = whole("p_size"), F.col("p_partkey")
    f = F.struct(F.lit("P1").alias("id"), F.lit("f").alias("name"), F.concat(F.lit("x + "), size).alias("body"))
    g = F.struct(F.lit("P2").alias("id"), F.lit("g").alias("name"), F.lit("2 * x").alias("body"))
    definitions = F.when(F.col("p_size") % 5 == 0, F.array(f)).otherwise(F.array(f, g))
    claim = 2 * (key + F.col("p_size")) + F.pmod(key, F.lit(2))
    r = udfs()["definitions_value"](F.concat(F.lit("g(f("), key.cast("string"), F.lit(")) = "), claim.cast("string")), definitions)
    return t.part.select("p_partkey", r.alias("r")).select("p_partkey", "r.status", "r.needed")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'CONSISTENT_UNDER_BINDINGS' WHEN 1 THEN 'DIMENSION_MISMATCH' WHEN 2 THEN 'NOT_ASSESSED' ELSE 'CONSISTENT_UNDER_BINDINGS' END AS status FROM nation")
def rul_06_dimensions(t: Tables) -> DataFrame:
    """Dimensions on both sides of formulas."""
    formulas = F.array(*map(F.lit, ("Q = I * t", "V = I * t + 2 * Q", "W = Q * Z", "W = V^2 * t / R")))
    bindings = F.create_map(*map(F.lit, ("Q", "charge", "I", "current", "t", "time", "V", "voltage", "W", "work", "R", "resistance")))
    return t.nation.select("n_nationkey", udfs()["dimension_check"](F.get(formulas, F.pmod("n_nationkey", F.lit(4))), bindings).alias("status"))


LITERALS_SQL = rf"list_distinct(list_transform(regexp_extract_all({{}}, '{LITERAL}'), lambda v: regexp_replace(regexp_replace(regexp_replace(v, '(\.[0-9]*?)0+$', '\1'), '\.$', ''), '^0+([0-9])', '\1')))"


@query(f"""
SELECT doc_id, list_sort(u) AS unsupported, CASE WHEN len(list_filter(u, lambda v: len(v) > 30)) > 0 THEN 'REVIEW_REQUIRED' WHEN len(u) > 0 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS status
FROM (SELECT doc_id, list_filter({LITERALS_SQL.format('text')}, lambda v: NOT list_contains({LITERALS_SQL.format('source')}, v)) AS u FROM documents)""")
def rul_08_numeric_support(t: Tables) -> DataFrame:
    """Numbers of a text that its other column doesn't give, as whole literals; longer ones than 30 digits go to review."""
    found = t.documents.select("doc_id", F.array_sort(F.array_except(literals(F.col("text")), literals(F.col("source")))).alias("unsupported"))
    long = F.exists("unsupported", lambda v: F.length(v) > 30)
    return found.withColumn("status", F.when(long, "REVIEW_REQUIRED").when(F.size("unsupported") > 0, "UNSUPPORTED").otherwise("SUPPORTED"))


@query("SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'ABSTAIN' WHEN toxic = 1 THEN 'FAIL_GAP' ELSE 'PASS' END AS status FROM labels")
def rul_09_gap_guard(t: Tables) -> DataFrame:
    """A claimed gap counts only if the context was complete."""
    gap, complete = F.col("toxic") == 1, F.col("quality") == 1
    return t.labels.select("doc_id", F.when(gap & ~complete, "ABSTAIN").when(gap, "FAIL_GAP").otherwise("PASS").alias("status"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) || ' controls the flow' END AS witness FROM nation")
def rul_15_relation_witness(t: Tables) -> DataFrame:
    """Clauses that state a relation; qualified ones don't count."""
    texts = F.array(F.concat("n_name", F.lit(" controls the flow. More.")), F.concat("n_name", F.lit(" may control the flow.")), F.concat(F.lit("The flow controls "), "n_name"))
    return t.nation.select("n_nationkey", relation_witness(F.lit("CONTROLS"), F.col("n_name"), F.lit("the flow"), F.get(texts, F.pmod("n_nationkey", F.lit(3)))).alias("witness"))


@query("SELECT doc_id, contains(text, '=') OR contains(text, '+') OR contains(text, '^') AS mathlike FROM documents")
def rul_21_mathlike(t: Tables) -> DataFrame:
    """Whether a text looks like mathematics."""
    return t.documents.select("doc_id", contains_any(F.col("text"), ["=", "+", "^"]).alias("mathlike"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice = round(l_quantity * 1000, 2) AS agrees FROM lineitem".replace("l_extendedprice = round(l_quantity * 1000, 2)", "l_quantity::DECIMAL(18,4) * 1000 = l_extendedprice::DECIMAL(18,4)"))
def rul_24_numeric_agreement(t: Tables) -> DataFrame:
    """Agreement of decimals, without binary rounding."""
    d = lambda c: F.col(c).cast("decimal(18,4)")
    return t.lineitem.select("l_orderkey", "l_linenumber", (d("l_quantity") * 1000 == d("l_extendedprice")).alias("agrees"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'withhold' WHEN 'O' THEN 'conditional' ELSE 'answer' END AS outcome FROM orders")
def rul_26_transfer(t: Tables) -> DataFrame:
    """What a transfer case should lead to."""
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "F", "withhold").when(s == "O", "conditional").otherwise("answer").alias("outcome"))


@query()
def scf_01_evidence_units(t: Tables) -> DataFrame:
    """Sentence-like units of all documents, with exact offsets."""
    return corpus.evidence_units(t.documents, "doc_id", "text")


@query("SELECT p_partkey, '+(n' || 'x)' AS form FROM part".replace("'+(n' || 'x)'", "'+(' || p_partkey || ',' || p_size || ',*(2,x,y))'"))
def scf_40_normal_form(t: Tables) -> DataFrame:
    """Normal forms: nesting of sums and products doesn't matter."""
    e = F.concat(whole("p_partkey"), F.lit(" + ("), whole("p_size"), F.lit(" + 2 * (x * y))"))
    return t.part.select("p_partkey", udfs()["normal_form"](e).alias("form"))
