"""Rate windows, ledgers, resumed runs, and routing of call results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import rates
from .registry import Tables, query


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60999999 PRECEDING AND CURRENT ROW), 4) AS used FROM events")
def str_01_rolling_rate(t: Tables) -> DataFrame:
    """Use within the last 61 seconds, per kind of call."""
    return rates.rolling_sum(t.events, "event_type", "ts", "value").select("event_id", F.round("used", 4).alias("used"))


LEDGER = """
WITH x AS (SELECT user_id, list({{'o': event_id, 'c': value::DECIMAL(20,6)}} ORDER BY event_id) AS xs FROM events GROUP BY 1),
f AS (SELECT user_id, list_reduce(xs, lambda acc, x: CASE WHEN acc.spent + x.c <= 100 THEN {{'spent': (acc.spent + x.c)::DECIMAL(20,6), 'rows': list_append(acc.rows, {{'o': x.o, 'a': true, 's': (acc.spent + x.c)::DECIMAL(20,6)}})}} ELSE {{'spent': acc.spent, 'rows': list_append(acc.rows, {{'o': x.o, 'a': false, 's': acc.spent}})}} END,
  {{'spent': 0::DECIMAL(20,6), 'rows': []::STRUCT(o BIGINT, a BOOLEAN, s DECIMAL(20,6))[]}}) AS a FROM x),
r AS (SELECT user_id, unnest(a.rows) AS r FROM f) {}"""


@query(LEDGER.format("SELECT user_id, r.o AS event_id, r.a AS admitted, r.s::DOUBLE AS spent FROM r"))
def str_02_ledger(t: Tables) -> DataFrame:
    """Calls that a budget admits, in order, and what is spent."""
    return rates.ledger(t.events, "user_id", "event_id", "value", 100).select("user_id", "event_id", "admitted", F.col("spent").cast("double").alias("spent"))


@query(LEDGER.format("SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE NOT r.a) AS refused, max(r.s)::DOUBLE AS spent FROM r GROUP BY 1"))
def str_03_spend(t: Tables) -> DataFrame:
    """Calls, refusals and total spend of each ledger."""
    rows = rates.ledger(t.events, "user_id", "event_id", "value", 100)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("admitted")).alias("refused"), F.max("spent").cast("double").alias("spent"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def str_04_unprocessed(t: Tables) -> DataFrame:
    """Items without a result."""
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag != 'R')")
def str_05_rerun(t: Tables) -> DataFrame:
    """Items whose results are missing or errors only."""
    return t.orders.join(t.lineitem.where("l_returnflag != 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT conv_id, (sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) // 5000)::BIGINT AS flush, turn FROM conversations")
def str_06_flush_groups(t: Tables) -> DataFrame:
    """Which flush of a buffer an item belongs to."""
    from pyspark.sql.window import Window

    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", F.floor(F.sum(F.length("text")).over(line) / 5000).alias("flush"), "turn")


@query("SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type, round(sum(value), 4) AS used, count(*) AS n FROM events GROUP BY ALL")
def str_07_tumbling_rates(t: Tables) -> DataFrame:
    """Use per minute and kind (an addition of this engine)."""
    w = rates.windowed_rates(t.events, "event_type", "ts", "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("minute"), "event_type", F.round("used", 4).alias("used"), "n")


@query("SELECT conv_id, sha256(string_agg(turn || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def str_12_source_digest(t: Tables) -> DataFrame:
    """A digest of each source's records, to show that they didn't change."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("turn").cast("string"), F.lit(":"), "text").alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN len(text) < 50 THEN 'general' ELSE lang END AS topic, md5(substr(text, 1, 3000)) AS request FROM documents")
def str_14_topic_request(t: Tables) -> DataFrame:
    """What would be sent for a topic, and the default for what is too short to be sent."""
    short = F.length("text") < 50
    return t.documents.select("doc_id", F.when(short, "general").otherwise(F.col("lang")).alias("topic"), F.md5(F.substring("text", 1, 3000)).alias("request"))


@query("SELECT label, list(vec_id ORDER BY vec_id)[1:3] AS topics FROM embeddings GROUP BY 1")
def str_15_few_topics(t: Tables) -> DataFrame:
    """At most three topics of each group go into a request."""
    from ..operators.select import top_k

    few = top_k(t.embeddings.select("label", "vec_id"), ["label"], [F.col("vec_id")], 3)
    return few.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("topics"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_brand), '1') THEN 'one' WHEN contains(lower(p_brand), '2') THEN 'two' ELSE 'other' END AS bucket FROM part")
def pip_14_source_buckets(t: Tables) -> DataFrame:
    """Concepts by keywords of their first source."""
    b = F.lower("p_brand")
    return t.part.select("p_partkey", F.when(b.contains("1"), "one").when(b.contains("2"), "two").otherwise("other").alias("bucket"))


@query("SELECT CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey ELSE s_nationkey END AS src, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE s_suppkey END AS dst FROM supplier WHERE s_acctbal / 10000 > 0.5")
def pip_13_directed_relations(t: Tables) -> DataFrame:
    """Confident relations, turned round where they point the other way."""
    straight = F.col("s_nationkey") % 2 == 0
    nation = F.col("s_nationkey").cast("long")
    return t.supplier.where("s_acctbal / 10000 > 0.5").select(F.when(straight, F.col("s_suppkey")).otherwise(nation).alias("src"), F.when(straight, nation).otherwise(F.col("s_suppkey")).alias("dst"))


@query()
def rul_18_controlled_cases(t: Tables) -> DataFrame:
    """Generated cases solved from what lies before their targets: expected against found."""
    from ..operators.curricula import controlled_cases, solve

    return solve(controlled_cases(t.spark)).groupBy("category", "expected", "status").agg(F.count(F.lit(1)).alias("n"))


def sentences_of(last: DataFrame) -> DataFrame:
    """The requirements of targets: every sentence that isn't blank, numbered."""
    lines = F.filter(F.split("text", r"[.\n]+"), lambda v: F.length(F.trim(v)) > 0)
    return last.select(F.concat_ws(":", "conv_id", "turn").alias("target_id"), F.posexplode(lines).alias("requirement_id", "requirement"))


@query()
def pip_01_evidence_audit(t: Tables) -> DataFrame:
    """The audit of all conversations with the offline completion: a status per target."""
    from ..operators.audit import audit
    from ..operators.corpus import conversation_records, last_turns
    from ..operators.rounds import shared_folder

    c = t.conversations
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))
    found = audit(conversation_records(c), last_turns(c), sentences_of(last), shared_folder(t.spark, "audit"))
    return found["targets"]
