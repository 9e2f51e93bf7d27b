"""Aggregations and evaluation statistics.

Labels stand for experiment rows: quality is what was expected, toxic what was
predicted, the document's language the arm and its source the family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from .registry import Tables, query

RUNS = "(SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def runs(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")



def count() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))



@query(f"""
SELECT lang, count(*) AS attempts, count(*) FILTER (WHERE quality = toxic) AS matches, round(avg(n_chars), 6) AS mean_chars,
  round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS precision_1,
  round(count(*) FILTER (WHERE quality = 1 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS recall_1
FROM {RUNS} GROUP BY lang""")
def agg_01_run_summary(t: Tables) -> DataFrame:
    """Per arm: attempts, matches, mean size, precision and recall of the positive class (null without a denominator)."""
    both = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1))
    return runs(t).groupBy("lang").agg(
        count().alias("attempts"), F.count_if(F.col("quality") == F.col("toxic")).alias("matches"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.round(stats.share(both, F.count_if(F.col("toxic") == 1)), 6).alias("precision_1"), F.round(stats.share(both, F.count_if(F.col("quality") == 1)), 6).alias("recall_1"),
    )


@query(f"""
WITH m AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, avg((quality = toxic)::INT::DOUBLE) AS m FROM {RUNS} GROUP BY source),
n AS (SELECT count(*) AS n FROM m),
picks AS (SELECT s.range AS sample, ('0x' || substr(md5(s.range || ':' || p.range), 1, 15))::BIGINT % n AS i FROM range(1000) s, n, range(100000) p WHERE p.range < n),
means AS (SELECT sample, avg(m) AS m FROM picks JOIN m USING (i) GROUP BY sample), r AS (SELECT m, row_number() OVER (ORDER BY m) AS k FROM means)
SELECT (SELECT n FROM n) AS families, round((SELECT avg(m) FROM m), 6) AS mean, round((SELECT m FROM r WHERE k = 25), 6) AS low, round((SELECT m FROM r WHERE k = 975), 6) AS high""")
def agg_02_cluster_bootstrap(t: Tables) -> DataFrame:
    """Mean agreement over sources and its bootstrap interval."""
    values = runs(t).select("source", (F.col("quality") == F.col("toxic")).cast("double").alias("hit"))
    return stats.cluster_bootstrap(values, "source", "hit").select("families", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"""
SELECT lang, count(*) FILTER (WHERE toxic > quality) AS gained, count(*) FILTER (WHERE toxic < quality) AS lost, round((SELECT avg(m) FROM (SELECT avg(toxic - quality) AS m FROM {RUNS} i WHERE i.lang = o.lang GROUP BY source)), 6) AS family_mean
FROM {RUNS} o GROUP BY lang""")
def agg_03_paired_difference(t: Tables) -> DataFrame:
    """Gains, losses, and the mean of the families' mean differences."""
    r = runs(t)
    means = r.groupBy("lang", "source").agg(F.avg(F.col("toxic") - F.col("quality")).alias("m")).groupBy("lang").agg(F.round(F.avg("m"), 6).alias("family_mean"))
    return r.groupBy("lang").agg(F.count_if(F.col("toxic") > F.col("quality")).alias("gained"), F.count_if(F.col("toxic") < F.col("quality")).alias("lost")).join(means, "lang")


WILSON = "(k / n + {z2} / (2 * n) {sign} {z} * sqrt(k / n * (1 - k / n) / n + {z2} / (4 * n * n))) / (1 + {z2} / n)"
LOW, HIGH = (WILSON.format(z=stats.Z95, z2=stats.Z95**2, sign=s) for s in "-+")


@query(f"""
SELECT event_type, n::BIGINT AS n, k::BIGINT AS large, round(greatest(0, {LOW}), 6) AS low, round(least(1, {HIGH}), 6) AS high, tokens FROM (
  SELECT event_type, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE value > 20))::DOUBLE AS k, round(sum(value), 2) AS tokens FROM events GROUP BY 1)""")
def agg_04_arm_summary(t: Tables) -> DataFrame:
    """Per arm: attempts, hits with their interval, and token sums."""
    k, n = F.col("large").cast("double"), F.col("n").cast("double")
    g = t.events.groupBy("event_type").agg(count().alias("n"), F.count_if(F.col("value") > 20).alias("large"), F.round(F.sum("value"), 2).alias("tokens"))
    return g.select("event_type", "n", "large", F.round(stats.wilson(k, n, False), 6).alias("low"), F.round(stats.wilson(k, n, True), 6).alias("high"), "tokens")


@query(f"SELECT lang, round(greatest(0, {LOW}), 6) AS low, round(least(1, {HIGH}), 6) AS high FROM (SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM {RUNS} GROUP BY 1)")
def agg_05_wilson(t: Tables) -> DataFrame:
    """The Wilson interval of the share of good documents by language."""
    g = runs(t).groupBy("lang").agg(count().cast("double").alias("n"), F.sum("quality").cast("double").alias("k"))
    return g.select("lang", F.round(stats.wilson(F.col("k"), F.col("n"), False), 6).alias("low"), F.round(stats.wilson(F.col("k"), F.col("n"), True), 6).alias("high"))


@query(f"""
SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS wins, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS losses, count(*) FILTER (WHERE quality = toxic) AS ties, round(median(n_chars), 6) AS median_chars,
  round(quantile_cont(n_chars::DOUBLE, 0.025), 6) AS low, round(quantile_cont(n_chars::DOUBLE, 0.975), 6) AS high FROM {RUNS} GROUP BY 1""")
def agg_06_score_summary(t: Tables) -> DataFrame:
    """Wins, losses, ties, median and interpolated percentiles."""
    q, x = F.col("quality"), F.col("toxic")
    p = lambda v: F.round(F.percentile("n_chars", F.lit(v)), 6)
    return runs(t).groupBy("lang").agg(F.count_if((q == 1) & (x == 0)).alias("wins"), F.count_if((q == 0) & (x == 1)).alias("losses"), F.count_if(q == x).alias("ties"), p(0.5).alias("median_chars"), p(0.025).alias("low"), p(0.975).alias("high"))


TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"


@query(f"""
WITH j AS (SELECT item_id, {TOKENS.format('b.text')} AS want, {TOKENS.format('d.text')} AS got FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, len(list_intersect(got, want))::INT AS tp, (len(got) - len(list_intersect(got, want)))::INT AS fp, (len(want) - len(list_intersect(got, want)))::INT AS fn FROM j""")
def agg_07_binding_scores(t: Tables) -> DataFrame:
    """Set-based true and false positives and false negatives per case."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    j = t.benchmark.select("item_id", words("text").alias("want")).join(t.documents.select(F.col("doc_id").alias("item_id"), words("text").alias("got")), "item_id")
    tp, fp, fn = stats.set_scores(F.col("want"), F.col("got"))
    return j.select("item_id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


@query(f"""
SELECT source, count(*) FILTER (WHERE toxic = 0) AS accepted, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS accepted_right, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS wrong_withheld,
  round(count(*) FILTER (WHERE toxic = 0 AND quality = 1) / nullif(count(*) FILTER (WHERE toxic = 0), 0), 6) AS conditional FROM {RUNS} GROUP BY 1""")
def agg_08_guard_metrics(t: Tables) -> DataFrame:
    """What a guard lets through and what it holds back."""
    q, x = F.col("quality"), F.col("toxic")
    ok, right = F.count_if(x == 0), F.count_if((x == 0) & (q == 1))
    return runs(t).groupBy("source").agg(ok.alias("accepted"), right.alias("accepted_right"), F.count_if((x == 1) & (q == 0)).alias("wrong_withheld"), F.round(stats.share(right, ok), 6).alias("conditional"))


@query("SELECT event_type, count(*) FILTER (WHERE value IS NULL) AS errors, count(*) FILTER (WHERE value < 5) AS flags, round(sum(value), 3) AS elapsed FROM events GROUP BY 1")
def agg_09_control_metrics(t: Tables) -> DataFrame:
    """Errors, flags and rounded sums per arm."""
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("errors"), F.count_if(F.col("value") < 5).alias("flags"), F.round(F.sum("value"), 3).alias("elapsed"))


@query("SELECT o_orderpriority AS arm, count(*) AS planned, count(n) AS done, coalesce(sum(n), 0)::BIGINT AS calls FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def agg_10_planned_summary(t: Tables) -> DataFrame:
    """Plans against results; what has no result stays in the denominator."""
    done = t.lineitem.groupBy("l_orderkey").agg(count().alias("n"))
    return t.orders.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderpriority").alias("arm")).agg(count().alias("planned"), F.count("n").alias("done"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"))


@query("SELECT c_mktsegment, coalesce(o_orderstatus, 'UNATTEMPTED') AS status, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def agg_11_unattempted(t: Tables) -> DataFrame:
    """Status histogram in which the unattempted are a status."""
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_mktsegment", F.coalesce("o_orderstatus", F.lit("UNATTEMPTED")).alias("status")).agg(count().alias("n"))


@query("SELECT d.lang, count(*) AS n, count(quality) AS labelled, round(avg(quality), 6) AS accuracy FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_12_labelled_subset(t: Tables) -> DataFrame:
    """All rows, the labelled ones among them, and their mean (null without labels)."""
    return t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(count().alias("n"), F.count("quality").alias("labelled"), F.round(F.avg("quality"), 6).alias("accuracy"))


@query("""
WITH r AS (SELECT conv_id, list(turn) FILTER (WHERE role = 'user') AS need, list(turn) FILTER (WHERE len(text) > 100) AS got FROM conversations GROUP BY 1)
SELECT count(*) AS cases, sum(len(coalesce(need, [])))::BIGINT AS available, sum(len(list_intersect(coalesce(need, []), coalesce(got, []))))::BIGINT AS recovered FROM r""")
def agg_13_retrieval_recall(t: Tables) -> DataFrame:
    """Required passages and how many of them were retrieved."""
    r = t.conversations.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", F.col("turn"))).alias("need"), F.collect_set(F.when(F.length("text") > 100, F.col("turn"))).alias("got"))
    return r.agg(count().alias("cases"), F.sum(F.size("need")).alias("available"), F.sum(F.size(F.array_intersect("need", "got"))).alias("recovered"))


@query("SELECT o_orderpriority, count(*) AS total, round(100 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) / count(*), 4) AS valid_percent FROM orders GROUP BY 1")
def agg_14_status_share(t: Tables) -> DataFrame:
    """Share of rows in some states."""
    return t.orders.groupBy("o_orderpriority").agg(count().alias("total"), F.round(100 * F.count_if(F.col("o_orderstatus").isin("F", "O")) / count(), 4).alias("valid_percent"))


@query("SELECT label, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('region'), ('nation'), ('formula')) v(label) LEFT JOIN (SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation) USING (label)")
def agg_15_graph_stats(t: Tables) -> DataFrame:
    """Counts per declared label, zero included."""
    labels = t.spark.createDataFrame([("region",), ("nation",), ("formula",)], "label string")
    found = t.region.select(F.lit("region").alias("label")).unionAll(t.nation.select(F.lit("nation"))).groupBy("label").agg(count().alias("n"))
    return labels.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_returnflag || l_linestatus AS type, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC")
def agg_16_edges_by_type(t: Tables) -> DataFrame:
    """Edges by type, most frequent first."""
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("type")).agg(count().alias("n")).orderBy(F.desc("n"))


@query("SELECT p_type, count(*) AS n, count(DISTINCT p_name) AS concepts FROM part GROUP BY 1 ORDER BY n DESC")
def agg_17_topic_stats(t: Tables) -> DataFrame:
    """Rows and distinct concepts by topic."""
    return t.part.groupBy("p_type").agg(count().alias("n"), F.countDistinct("p_name").alias("concepts")).orderBy(F.desc("n"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def agg_18_manifest(t: Tables) -> DataFrame:
    """Counts by language, by source, and of all, in one pass."""
    return t.documents.groupingSets([["lang"], ["source"], []], "lang", "source").agg(count().alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) = count(*) AS unique_ids, (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size <= 25 INTERSECT SELECT p_brand FROM part WHERE p_size > 25)) AS shared FROM part")
def agg_19_benchmark_checks(t: Tables) -> DataFrame:
    """Size, unique ids, and groups that two splits share."""
    low, high = (t.part.where(c).select("p_brand") for c in ("p_size <= 25", "p_size > 25"))
    shared = low.intersect(high).agg(count().alias("shared"))
    return t.part.agg(count().alias("n"), (F.countDistinct("p_partkey") == count()).alias("unique_ids")).crossJoin(F.broadcast(shared))


@query("SELECT user_id % 5 AS model, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1), 6) AS error_rate FROM events GROUP BY 1")
def agg_20_rates(t: Tables) -> DataFrame:
    """Error rate per model."""
    return t.events.groupBy((F.col("user_id") % 5).alias("model")).agg(F.round(F.count_if(F.col("event_type") == "error") / F.greatest(count(), F.lit(1)), 6).alias("error_rate"))


@query("SELECT count(*) AS n, max(len(embedding))::INT AS dimension, list_sort(list(DISTINCT label)) AS labels FROM embeddings")
def agg_21_collection_stats(t: Tables) -> DataFrame:
    """Size, dimension and metadata values of a vector collection."""
    return t.embeddings.agg(count().alias("n"), F.max(F.size("embedding")).alias("dimension"), F.array_sort(F.collect_set("label")).alias("labels"))


@query("SELECT lang, count(*) FILTER (WHERE contains(text, '=')) AS formulas, count(*) FILTER (WHERE NOT contains(text, '=')) AS texts FROM documents GROUP BY 1")
def agg_22_block_counts(t: Tables) -> DataFrame:
    """Counters by kind of block."""
    has = F.col("text").contains("=")
    return t.documents.groupBy("lang").agg(F.count_if(has).alias("formulas"), F.count_if(~has).alias("texts"))


@query("SELECT p_brand, count(DISTINCT p_size % 3) AS splits, count(DISTINCT p_size % 3) = 1 AS sound FROM part GROUP BY 1")
def agg_23_group_splits(t: Tables) -> DataFrame:
    """Whether each group lies in one split."""
    splits = F.countDistinct(F.col("p_size") % 3)
    return t.part.groupBy("p_brand").agg(splits.alias("splits"), (splits == 1).alias("sound"))


@query("SELECT quality, toxic, count(*) AS n, count(DISTINCT sha256(text)) AS payloads FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def agg_24_label_audit(t: Tables) -> DataFrame:
    """Rows and distinct payloads per label pair."""
    return t.labels.join(t.documents, "doc_id").groupBy("quality", "toxic").agg(count().alias("n"), F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)).alias("payloads"))


@query(f"SELECT lang, count(*) AS completed, count(*) FILTER (WHERE quality = toxic) AS matches, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS false_support FROM {RUNS} GROUP BY 1")
def agg_25_prompt_scores(t: Tables) -> DataFrame:
    """Requirement scores per arm."""
    q, x = F.col("quality"), F.col("toxic")
    return runs(t).groupBy("lang").agg(count().alias("completed"), F.count_if(q == x).alias("matches"), F.count_if((x == 1) & (q == 0)).alias("false_support"))


@query("SELECT l_linenumber AS ordinal, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def agg_26_by_ordinal(t: Tables) -> DataFrame:
    """Results by their place in the plan."""
    return t.lineitem.groupBy(F.col("l_linenumber").alias("ordinal")).agg(count().alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def agg_27_heatmap(t: Tables) -> DataFrame:
    """A matrix of counts: chapters by verdicts."""
    return t.orders.groupBy("o_orderpriority").agg(*stats.histogram(F.col("o_orderstatus"), ["F", "O", "P"]))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus != 'P') AS valid, count(*) FILTER (WHERE o_orderstatus = 'O') AS gaps, floor(count(*) * 0.4)::BIGINT AS projected FROM orders")
def agg_28_funnel(t: Tables) -> DataFrame:
    """Stages of a funnel and a projection."""
    s = F.col("o_orderstatus")
    return t.orders.agg(count().alias("total"), F.count_if(s != "P").alias("valid"), F.count_if(s == "O").alias("gaps"), F.floor(count() * 0.4).alias("projected"))
