"""Row contracts: coverage, admissible values, unique ids, and statuses that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables, query


def count() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))

ROUTES = "(SELECT conv_id, list_sort(list(turn) FILTER (WHERE role = 'user')) AS need, list_sort(list(turn) FILTER (WHERE len(text) > 200)) AS route, max(turn) + 1 AS n FROM conversations GROUP BY 1)"


def routes(t: Tables) -> DataFrame:
    """Required turns, a route of turns, and the number of turns, per conversation."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("turn"))))
    return t.conversations.groupBy("conv_id").agg(pick(F.col("role") == "user").alias("need"), pick(F.length("text") > 200).alias("route"), (F.max("turn") + 1).alias("n"))


@query(f"SELECT conv_id, len(list_filter(coalesce(need, []), lambda v: NOT list_contains(coalesce(route, []), v))) = 0 AS covered FROM {ROUTES}")
def val_01_routes(t: Tables) -> DataFrame:
    """Whether a route covers all that is required."""
    return routes(t).select("conv_id", (F.size(F.array_except("need", "route")) == 0).alias("covered"))


@query(f"SELECT conv_id, coalesce(list_bool_and(list_transform(range(1, len(coalesce(route, [])) + 1), lambda i: route[i] >= i - 1)), true) AS ordered FROM {ROUTES}".replace("list_bool_and(list_transform(range(1, len(coalesce(route, [])) + 1), lambda i: route[i] >= i - 1))", "len(list_filter(range(1, len(coalesce(route, [])) + 1), lambda i: route[i] < i - 1)) = 0"))
def val_02_joint_witness(t: Tables) -> DataFrame:
    """Every step uses only what earlier steps made available."""
    bad = F.filter(F.transform("route", lambda v, i: v < i), lambda b: b)
    return routes(t).select("conv_id", (F.size(bad) == 0).alias("ordered"))


@query(f"SELECT conv_id, len(coalesce(need, [])) = len(list_distinct(coalesce(need, []))) AND n = len(list_distinct(list_concat(coalesce(need, []), coalesce(route, [])))) AS exact FROM {ROUTES}")
def val_04_exact_coverage(t: Tables) -> DataFrame:
    """Ids without repetition that together are all ids."""
    unique = F.size("need") == F.size(F.array_distinct("need"))
    return routes(t).select("conv_id", (unique & (F.col("n") == F.size(F.array_union("need", "route")))).alias("exact"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'MODEL_SUPPORTED' WHEN bool_or(o_orderstatus = 'P') THEN 'REVIEW_REQUIRED' ELSE 'UPSTREAM_READY' END AS status FROM orders GROUP BY 1")
def val_06_status(t: Tables) -> DataFrame:
    """A status from all of a case's requirements."""
    s = F.col("o_orderstatus")
    status = F.when(F.every(s == "F"), "MODEL_SUPPORTED").when(F.some(s == "P"), "REVIEW_REQUIRED").otherwise("UPSTREAM_READY")
    return t.orders.groupBy("o_custkey").agg(status.alias("status"))


@query("""SELECT event_id, list_filter([CASE WHEN event_type != 'purchase' AND value > 30 THEN 'answer_without_pass' END, CASE WHEN event_type = 'purchase' AND props IS NULL THEN 'no_citation' END, CASE WHEN value IS NULL THEN 'no_value' END], lambda v: v IS NOT NULL) AS issues FROM events""")
def val_08_response_contract(t: Tables) -> DataFrame:
    """All clauses of a contract that a row breaks."""
    passed = F.col("event_type") == "purchase"
    tests = {"answer_without_pass": ~passed & (F.col("value") > 30), "no_citation": passed & F.col("props").isNull(), "no_value": F.col("value").isNull()}
    return t.events.select("event_id", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items()))).alias("issues"))


@query("SELECT conv_id, count(*) = count(DISTINCT turn) AND min(turn) >= 0 AND bool_and(role IN ('user', 'assistant', 'system')) AS valid FROM conversations GROUP BY 1")
def val_11_payload(t: Tables) -> DataFrame:
    """Unique positions, none below zero, known roles."""
    ok = (count() == F.countDistinct("turn")) & (F.min("turn") >= 0) & F.every(F.col("role").isin("user", "assistant", "system"))
    return t.conversations.groupBy("conv_id").agg(ok.alias("valid"))


@query("SELECT l_orderkey, count(*) AS reviews, bool_and(n = 1) AS once FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def val_13_coverage_once(t: Tables) -> DataFrame:
    """Whether every claim was reviewed exactly once."""
    per = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(count().alias("n"))
    return per.groupBy("l_orderkey").agg(count().alias("reviews"), F.every(F.col("n") == 1).alias("once"))


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'UNCERTAIN' ELSE 'USABLE' END AS review FROM labels")
def val_14_review(t: Tables) -> DataFrame:
    """Reviews with a reason against them are uncertain."""
    return t.labels.select("doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "UNCERTAIN").otherwise("USABLE").alias("review"))


@query("SELECT count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]+$')) AS misnamed FROM (SELECT p_partkey, any_value(p_brand) AS p_brand, count(*) AS n FROM part GROUP BY 1)")
def val_15_case_list(t: Tables) -> DataFrame:
    """Repeated ids and names that don't fit the pattern."""
    per = t.part.groupBy("p_partkey").agg(F.first("p_brand").alias("p_brand"), count().alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("p_brand").rlike("^Brand#[0-9]+$")).alias("misnamed"))


@query("SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS cutoff FROM conversations GROUP BY 1")
def val_16_cutoffs(t: Tables) -> DataFrame:
    """The first target of each source."""
    return t.conversations.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("cutoff"))


@query("SELECT l_partkey, count(*) AS n, count(*) - count(DISTINCT l_suppkey) AS repeated FROM lineitem GROUP BY 1 HAVING count(*) != count(DISTINCT l_suppkey)")
def val_17_unique_relations(t: Tables) -> DataFrame:
    """Nodes with repeated relations."""
    g = t.lineitem.groupBy("l_partkey").agg(count().alias("n"), (count() - F.countDistinct("l_suppkey")).alias("repeated"))
    return g.where("repeated > 0")


@query("SELECT c_mktsegment, bool_and(c_acctbal > -900) AS authorised, count(*) FILTER (WHERE c_acctbal <= -900) AS wrong FROM customer GROUP BY 1")
def val_19_gate(t: Tables) -> DataFrame:
    """A gate opens only if all of its cases are right."""
    ok = F.col("c_acctbal") > -900
    return t.customer.groupBy("c_mktsegment").agg(F.every(ok).alias("authorised"), F.count_if(~ok).alias("wrong"))


@query("SELECT a.doc_id FROM documents a LEFT JOIN (SELECT doc_id, sha256(regexp_replace(text, '#+', '', 'g')) AS h FROM documents) b ON a.doc_id = b.doc_id AND sha256(a.text) = b.h WHERE b.doc_id IS NULL")
def val_20_changed_files(t: Tables) -> DataFrame:
    """Rows whose digest isn't in the frozen manifest."""
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("h")
    frozen = t.documents.select("doc_id", digest(F.regexp_replace("text", "#+", "")))
    return t.documents.select("doc_id", digest(F.col("text"))).join(frozen, ["doc_id", "h"], "left_anti").select("doc_id")


@query("SELECT event_id, CASE WHEN TRY_CAST(props->>'k' AS INT) IS NULL THEN 'ERROR' WHEN TRY_CAST(props->>'k' AS INT) > 50 THEN 'ABSTAIN' ELSE upper(event_type) END AS verdict FROM events")
def val_22_verdict_contract(t: Tables) -> DataFrame:
    """A verdict that stands only if its parts can be read and its citation isn't later than the target."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", F.when(k.isNull(), "ERROR").when(k > 50, "ABSTAIN").otherwise(F.upper("event_type")).alias("verdict"))


@query("SELECT l.doc_id, l.quality = CASE WHEN d.n_chars % 2 = 0 THEN 1 ELSE 0 END AS replayed FROM labels l JOIN documents d USING (doc_id)")
def val_24_replay(t: Tables) -> DataFrame:
    """Saved decisions against recomputed ones."""
    again = F.when(F.col("n_chars") % 2 == 0, 1).otherwise(0)
    return t.labels.join(t.documents, "doc_id").select("doc_id", (F.col("quality") == again).alias("replayed"))
