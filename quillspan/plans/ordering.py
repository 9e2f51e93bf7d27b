"""Windows, top-k, budgets, sampling, set operations and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import select
from ..operators.ranges import running
from .registry import Tables, query


def count() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))



@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3 AND value > 0")
def win_01_top3(t: Tables) -> DataFrame:
    """Top three by score, then position; zero scores go after ranking."""
    top = select.top_k(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)
    return top.where("value > 0").select("user_id", "event_id", "rank")


@query("""
WITH s AS (SELECT conv_id, list({'r': turn, 's': len(text)} ORDER BY turn) AS xs FROM conversations GROUP BY 1),
f AS (SELECT conv_id, list_reduce(xs, lambda acc, x: CASE WHEN acc.used + x.s <= 1500 THEN {'used': acc.used + x.s, 'taken': list_append(acc.taken, x.r)} ELSE acc END, {'used': 0::BIGINT, 'taken': []::BIGINT[]}) AS a FROM s)
SELECT conv_id, unnest(a.taken) AS turn FROM f""")
def win_02_first_fit(t: Tables) -> DataFrame:
    """Turns that fit a budget of characters, skipping what doesn't."""
    d = t.conversations.select("conv_id", "turn", F.length("text").alias("size"))
    return select.first_fit(d, ["conv_id"], "turn", "size", 1500).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 1600")
def win_03_prefix_fit(t: Tables) -> DataFrame:
    """Turns before the budget is first exceeded."""
    return select.prefix_fit(t.conversations.withColumn("size", F.length("text")), ["conv_id"], [F.col("turn")], "size", 1600).select("conv_id", "turn")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 4")
def win_04_top4(t: Tables) -> DataFrame:
    """Top four by score, then id."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return select.top_k(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], order, 4).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 5")
def win_05_rerank(t: Tables) -> DataFrame:
    """A second score decides; ties keep their order."""
    scored = t.embeddings.select("label", "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("s"))
    return select.top_k(scored, ["label"], [F.desc("s"), F.col("vec_id")], 5).select("label", "vec_id", "rank")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN contains(text, '=') THEN 0 ELSE 1 END, doc_id) AS reserved, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS plain,
  count(*) FILTER (WHERE contains(text, '=')) OVER (PARTITION BY source) AS rules, contains(text, '=') AS rule FROM documents),
x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN reserved = 1 AND rules > 0 THEN 0 ELSE 1 END, doc_id) AS rank FROM r)
SELECT source, doc_id, rank FROM x WHERE rank <= 5""")
def win_06_reserved_slot(t: Tables) -> DataFrame:
    """The best rule statement first, then the others."""
    d = t.documents.select("source", "doc_id", F.col("text").contains("=").alias("rule"))
    best = d.where("rule").groupBy("source").agg(F.min("doc_id").alias("doc_id")).withColumn("slot", F.lit(0))
    ranked = d.join(best, ["source", "doc_id"], "left").withColumn("slot", F.coalesce("slot", F.lit(1)))
    return select.top_k(ranked, ["source"], [F.col("slot"), F.col("doc_id")], 5).select("source", "doc_id", "rank")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 50")
def win_07_round_robin(t: Tables) -> DataFrame:
    """A stratified sample, dealt from the languages in turn."""
    return select.round_robin(t.documents.select("lang", "doc_id"), "lang", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 50)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10")
def win_08_group_samples(t: Tables) -> DataFrame:
    """Ten of each source by a seeded key."""
    key = [F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    return select.top_k(t.documents.select("source", "doc_id"), ["source"], key, 10).select("source", "doc_id")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")
def win_09_source_order(t: Tables) -> DataFrame:
    """Rows in source order."""
    return t.conversations.select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("SELECT conv_id, turn, (conv_id + turn) % 3 AS arm FROM conversations")
def win_10_rotation(t: Tables) -> DataFrame:
    """Arms rotate with the case."""
    return t.conversations.select("conv_id", "turn", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)).alias("arm"))


@query("SELECT doc_id, printf('OUTPUT-%02d', row_number() OVER (ORDER BY md5('blind' || doc_id), doc_id)) AS alias FROM documents")
def win_11_blinding(t: Tables) -> DataFrame:
    """An alias for each document: its number in a seeded order, counted by ranges of that order."""
    key = F.coalesce(F.md5(F.concat(F.lit("blind"), F.col("doc_id").cast("string"))), F.lit("~"))  # no number goes last
    ranked = running(t.documents.select("doc_id", key.alias("key")), ["key", "doc_id"], None, "number_before")
    return ranked.select("doc_id", F.format_string("OUTPUT-%02d", F.col("number_before") + 1).alias("alias"))


@query("SELECT lang, min(doc_id) AS doc_id FROM documents WHERE n_chars BETWEEN 40 AND 1600 GROUP BY 1")
def win_12_first_per_group(t: Tables) -> DataFrame:
    """The first fitting row of each group."""
    return t.documents.where("n_chars BETWEEN 40 AND 1600").groupBy("lang").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def win_13_slice(t: Tables) -> DataFrame:
    """The first rows of a stated order."""
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r <= n // 2")
def win_14_first_half(t: Tables) -> DataFrame:
    """The first half of each group, rounded down."""
    w = Window.partitionBy("conv_id")
    d = t.conversations.withColumns({"r": F.row_number().over(w.orderBy("turn")), "n": count().over(w)})
    return d.where(F.col("r") <= F.floor(F.col("n") / 2)).select("conv_id", "turn")


BRANCHES = "(SELECT doc_id, 0 AS ord, 'vector' AS via FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id, 1, 'graph' FROM documents WHERE lang = 'en')"


def branches(t: Tables) -> DataFrame:
    d = t.documents
    return d.where("n_chars > 1000").select("doc_id", F.lit(0).alias("ord"), F.lit("vector").alias("via")).unionAll(d.where("lang = 'en'").select("doc_id", F.lit(1), F.lit("graph")))


@query(f"SELECT doc_id, arg_min(via, ord) AS via FROM {BRANCHES} GROUP BY 1")
def set_01_first_wins(t: Tables) -> DataFrame:
    """Two result lists merged, the first occurrence wins."""
    return select.first_wins(branches(t), ["doc_id"], "ord").select("doc_id", "via")


@query(f"SELECT doc_id, list(via ORDER BY ord) AS via FROM {BRANCHES} GROUP BY 1")
def set_02_merge_provenance(t: Tables) -> DataFrame:
    """Merged by id; later occurrences add their provenance."""
    return select.merge_provenance(branches(t), ["doc_id"], "ord", "via")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def set_03_same_passages(t: Tables) -> DataFrame:
    """Passages that occur more than once, by their content."""
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(count().alias("copies"), F.min("doc_id").alias("doc_id")).where("copies > 1")


@query("SELECT conv_id, list_distinct(list(role)).list_sort() AS roles FROM conversations GROUP BY 1")
def set_04_path_roles(t: Tables) -> DataFrame:
    """Distinct evidence roles per path."""
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


@query("SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set_05_unselected_paths(t: Tables) -> DataFrame:
    """Discovered paths that weren't selected."""
    pair = [F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")]
    return t.lineitem.where("l_quantity > 25").select(*pair).subtract(t.lineitem.where("l_returnflag = 'R'").select(*pair))


@query(r"SELECT doc_id, len(list_distinct(string_split(lower(text), ' ')))::INT AS words FROM documents")
def set_06_unique_in_order(t: Tables) -> DataFrame:
    """Ids without repetition."""
    return t.documents.select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), " "))).alias("words"))


@query("SELECT source, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def set_07_unique_context(t: Tables) -> DataFrame:
    """One row per span, the first id wins."""
    return t.documents.groupBy("source", F.md5(F.encode("text", "UTF-8")).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40")
def set_08_shared_groups(t: Tables) -> DataFrame:
    """Groups that two subsets share."""
    return t.part.where("p_size < 10").select("p_brand").intersect(t.part.where("p_size > 40").select("p_brand"))


@query("SELECT DISTINCT TRY_CAST(props->>'k' AS INT) AS k FROM events")
def set_09_exposures(t: Tables) -> DataFrame:
    """All ids found in JSON values."""
    return t.events.select(F.get_json_object("props", "$.k").try_cast("int").alias("k")).distinct()


@query("SELECT conv_id, 'E' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS evidence_id, turn FROM conversations WHERE role = 'assistant' UNION ALL SELECT DISTINCT conv_id, 'B0', -1 FROM conversations")
def set_10_catalog(t: Tables) -> DataFrame:
    """A catalog of background and numbered passages."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    e = t.conversations.where("role = 'assistant'").select("conv_id", F.concat(F.lit("E"), F.row_number().over(line) - 1).alias("evidence_id"), "turn")
    return e.unionAll(t.conversations.select("conv_id").distinct().select("conv_id", F.lit("B0"), F.lit(-1).cast("long")))


@query("SELECT conv_id, list(turn || ':' || len(text) ORDER BY turn) AS sizes FROM conversations GROUP BY 1")
def set_11_review_index(t: Tables) -> DataFrame:
    """An index from unique ids to texts, in order."""
    entries = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    return t.conversations.groupBy("conv_id").agg(F.transform(entries, lambda x: F.concat_ws(":", x["turn"], x["n"])).alias("sizes"))
