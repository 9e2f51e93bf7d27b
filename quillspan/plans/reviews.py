"""Contracts of readings, reviews and scored answers, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import udfs
from ..functions.textfn import only
from .claims import words
from .registry import Tables, query


def same_entries(a: Column, b: Column) -> Column:
    """Whether two maps have the same entries."""
    ordered = lambda m: F.array_sort(F.map_entries(m))
    return ordered(a) == ordered(b)


@query("""SELECT conv_id, coalesce(bool_and(turn % 3 != 2), true) AS exact, count(*) AS n FROM conversations GROUP BY 1""")
def val_03_task_readings(t: Tables) -> DataFrame:
    """Readings of a task must give every span word for word; one in three turns is read with a change."""
    spans = F.map_from_entries(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    read = F.map_from_entries(F.collect_list(F.struct("turn", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 2, "!").otherwise("")).alias("text"))))
    g = t.conversations.groupBy("conv_id").agg(spans.alias("spans"), read.alias("read"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", same_entries(F.col("spans"), F.col("read")).alias("exact"), "n")


@query("""WITH g AS (SELECT conv_id, list(turn) AS turns, count(*) AS n, bool_or(role = 'assistant') AS objects FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n % 2 = 1 AND len(turns) > 1 THEN 'context_not_read' WHEN objects AND n > 4 THEN 'judgments_disagree' END AS problem FROM g""")
def val_05_review_contract(t: Tables) -> DataFrame:
    """A review reads all of its context, and objects exactly if a judgment fails."""
    g = t.conversations.groupBy("conv_id").agg(F.collect_set("turn").alias("context"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role") == "assistant").alias("objects"))
    read = F.when(F.col("n") % 2 == 1, F.slice("context", 1, 1)).otherwise(F.col("context"))
    missing = F.size(F.array_except("context", read)) > 0
    judged = F.when(F.col("n") > 4, True).otherwise(~F.col("objects"))
    return g.select("conv_id", F.when(missing, "context_not_read").when(F.col("objects") == judged, "judgments_disagree").alias("problem"))


ANSWER = "status string, answer string, numeric_value string"


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus != 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'conflicting_answer' END
  WHEN o_orderkey % 3 = 0 THEN 'empty_answer' WHEN o_orderkey % 5 = 0 THEN 'no_matching_arithmetic' END AS problem FROM orders""")
def val_10_solver_contract(t: Tables) -> DataFrame:
    """Answers in JSON: one that passes has text and a value that some exact calculation gives; others are unavailable."""
    key = F.col("o_orderkey")
    passed = F.col("o_orderstatus") == "F"
    text = F.when(passed, F.when(key % 3 == 0, " ").otherwise("It is so.")).otherwise(F.when(key % 3 == 0, "It is so.").otherwise("Unavailable"))
    value = F.when(key % 5 == 0, key * 2 + 1).otherwise(key * 2)
    sent = F.to_json(F.struct(F.when(passed, "PASS").otherwise("ABSTAIN").alias("status"), text.alias("answer"), value.cast("string").alias("numeric_value")))
    r = t.orders.select("o_orderkey", F.from_json(sent, ANSWER).alias("a")).withColumn("c", udfs()["exact_calc"](words("2 * ", key), F.col("a.numeric_value")))
    ok = F.trim("a.answer") != ""
    problem = F.when((F.col("a.status") != "PASS") & (F.col("a.answer") != "Unavailable"), "conflicting_answer").when(~ok, "empty_answer")
    return r.select("o_orderkey", problem.when((F.col("a.status") == "PASS") & ~F.coalesce("c.consistent", F.lit(False)), "no_matching_arithmetic").alias("problem"))


@query("SELECT doc_id, coalesce(doc_id % 4 != 0 OR text IS NULL, true) AS holds FROM documents")
def val_21_packet_offsets(t: Tables) -> DataFrame:
    """Packets whose hash and offsets fit the source text; one in four was cut one character short."""
    kept = F.when(F.col("doc_id") % 4 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    p = t.documents.select("doc_id", "text", kept.alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").alias("end"))
    return p.select("doc_id", F.coalesce((F.sha2(F.col("kept").cast("binary"), 256) == F.col("digest")) & (F.length("kept") == F.col("end")), F.lit(True)).alias("holds"))


@query("SELECT p_partkey, p_partkey % 3 != 0 AS solves FROM part")
def rul_22_substitution(t: Tables) -> DataFrame:
    """Whether a value put in place of x makes both sides of an equation equal."""
    key, size = F.col("p_partkey"), F.col("p_size")
    equation = words("3 * x + ", size, " = ", 3 * key + size)
    value = words("(", key + F.when(key % 3 == 0, 1).otherwise(0), ")")
    sides = F.split(F.regexp_replace(equation, r"\bx\b", value), "=")
    r = udfs()["exact_calc"](words("(", F.get(sides, F.lit(0)), ") - (", F.get(sides, F.lit(1)), ")"), F.lit("0"))
    return t.part.select("p_partkey", r["consistent"].alias("solves"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'incomplete' WHEN value IS NULL THEN 'invalid' WHEN TRY_CAST(props->>'k' AS INT) % 10 = 0 THEN 'wrong' ELSE 'right' END AS outcome FROM events""")
def rul_25_diagnostic_score(t: Tables) -> DataFrame:
    """Answers of a diagnostic: incomplete, of invalid form, wrong or right."""
    answer = F.get_json_object("props", "$.k").try_cast("int")
    wrong = F.coalesce(F.pmod(answer, F.lit(10)) == 0, F.lit(False))
    return t.events.select("event_id", F.when(F.col("event_type") == "error", "incomplete").when(F.col("value").isNull(), "invalid").when(wrong, "wrong").otherwise("right").alias("outcome"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'CONSISTENT_UNDER_BINDINGS' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'DIMENSION_MISMATCH' END AS status FROM nation")
def rul_07_region_gate(t: Tables) -> DataFrame:
    """Dimensions of a region's only formula; clipped regions, or ones with other than one formula, need review."""
    texts = F.array(F.lit("Q = I * t"), F.lit("Q = I * t\nV = I"), F.lit("Q = I + t"))
    lines = F.filter(F.split(F.get(texts, F.col("n_nationkey") % 3), "\n"), lambda s: s.contains("="))
    bindings = F.create_map(*map(F.lit, ("Q", "charge", "I", "current", "t", "time")))
    return t.nation.select("n_nationkey", F.when(F.size(lines) == 1, udfs()["dimension_check"](only(lines), bindings)).otherwise("REVIEW_REQUIRED").alias("status"))


@query("SELECT * FROM (VALUES (0, 1), (1, 1), (2, 2), (3, 5), (4, 14), (5, 42)) v(nodes, trees)")
def rul_33_binary_trees(t: Tables) -> DataFrame:
    """Shapes of binary trees by their number of nodes, left and right told apart: all up to five nodes."""
    found = t.spark.createDataFrame([(0, ".")], "nodes int, shape string")
    for n in range(1, 6):
        left, right = found.select("nodes", F.col("shape").alias("l")), found.select((F.lit(n - 1) - F.col("nodes")).alias("nodes"), F.col("shape").alias("r"))
        found = found.unionAll(left.join(right, "nodes").select(F.lit(n).alias("nodes"), words("(", F.col("l"), F.col("r"), ")").alias("shape")))
    return found.groupBy("nodes").agg(F.count_distinct("shape").cast("int").alias("trees"))


@query("SELECT o_orderstatus AS phase, count(*) AS n, count(*) = count(DISTINCT o_orderkey) AS complete FROM orders GROUP BY 1")
def src_26_completed_run(t: Tables) -> DataFrame:
    """Phases of a run with their rows, and whether every key is there once."""
    return t.orders.groupBy(F.col("o_orderstatus").alias("phase"), "o_orderkey").agg(F.count(F.lit(1)).alias("k")).groupBy("phase").agg(F.sum("k").alias("n"), (F.max("k") == 1).alias("complete"))


@query("SELECT source, doc_id % 10 = 0 AS test, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def snk_10_splits(t: Tables) -> DataFrame:
    """What a frozen split records of each part: rows and characters."""
    return t.documents.groupBy("source", (F.col("doc_id") % 10 == 0).alias("test")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, strftime(ts, '%Y%m%dT%H%M%S') || 'Z' AS run_id FROM events")
def scf_35_time_names(t: Tables) -> DataFrame:
    """Times as ISO text and as names of runs."""
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("run_id"))


@query("""SELECT l_returnflag AS arm, count(*) AS planned, count(*) FILTER (WHERE l_discount <= 0.05) AS accepted, count(*) FILTER (WHERE l_discount <= 0.05 AND l_tax < 0.04) AS accepted_right, count(*) FILTER (WHERE l_tax < 0.04) AS right_before FROM lineitem GROUP BY 1""")
def pip_15_guard_replay(t: Tables) -> DataFrame:
    """What a guard accepts of stored answers: acceptance and correctness over all planned cases."""
    kept, right = F.col("l_discount") <= 0.05, F.col("l_tax") < 0.04
    return t.lineitem.groupBy(F.col("l_returnflag").alias("arm")).agg(F.count(F.lit(1)).alias("planned"), F.count_if(kept).alias("accepted"), F.count_if(kept & right).alias("accepted_right"), F.count_if(right).alias("right_before"))
