"""Text retrieval, vectors and composite retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scope import contains_any, is_worked_example
from ..functions.vectors import embed, latex_prompt
from ..operators import retrieval, select
from ..operators.corpus import conversation_records, eligible_records, last_turns
from .filters import EXAMPLE_SQL
from .registry import Tables, query

STOP = "[" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + "]"
TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[\p{{{{L}}}}\p{{{{N}}}}_]{{{{2,}}}}'), lambda x: NOT list_contains({STOP}, x))".replace("{{", "{").replace("}}", "}")


def tokens_sql(column: str) -> str:
    return TOKENS.replace("{}", column)


TFIDF = f"""
WITH t AS (SELECT conv_id, max(turn) AS p FROM conversations GROUP BY 1),
docs AS (SELECT c.conv_id, c.turn, {tokens_sql('c.text')} AS w FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn < t.p WHERE trim(regexp_replace(coalesce(c.text, ''), '\\s+', ' ', 'g')) != ''),
terms AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM docs),
tf AS (SELECT conv_id, turn, term, count(*) AS c FROM terms GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n FROM docs GROUP BY 1), df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT conv_id, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df JOIN n USING (conv_id)),
wt AS (SELECT conv_id, turn, term, (1 + ln(c)) * idf AS w FROM tf JOIN idf USING (conv_id, term)),
nrm AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
qd AS (SELECT c.conv_id, {tokens_sql('c.text')} AS w FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.p),
qt AS (SELECT conv_id, term, count(*) AS c FROM (SELECT conv_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM qd) GROUP BY ALL),
q AS (SELECT conv_id, term, (1 + ln(c)) * idf AS q FROM qt JOIN idf USING (conv_id, term)), qn AS (SELECT conv_id, sqrt(sum(q * q)) AS qn FROM q GROUP BY 1),
s AS (SELECT conv_id, turn, sum(w * q) / any_value(norm) / any_value(qn) AS score FROM wt JOIN q USING (conv_id, term) JOIN nrm USING (conv_id, turn) JOIN qn USING (conv_id) GROUP BY ALL),
r AS (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) AS rank FROM s)
"""


def ranked(t: Tables) -> DataFrame:
    """The three best passages before each conversation's last turn, which is the question."""
    c = t.conversations
    pairs = eligible_records(conversation_records(c), last_turns(c)).select("source_id", "position", "content")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumnRenamed("conv_id", "source_id")
    scores = retrieval.tf_idf(pairs, last, "source_id", "position")
    top = select.top_k(scores.withColumn("r9", F.round("score", 9)), ["source_id"], [F.desc("r9"), F.col("position")], 3)
    return top.join(pairs, ["source_id", "position"])


@query(TFIDF + "SELECT conv_id, turn, rank, round(score, 6) AS score FROM r WHERE rank <= 3 AND score > 0")
def txt_01_tf_idf(t: Tables) -> DataFrame:
    """TF-IDF over what each target may see; its three best passages."""
    return ranked(t).where("score > 0").select(F.col("source_id").alias("conv_id"), F.col("position").alias("turn"), "rank", F.round("score", 6).alias("score"))


@query(TFIDF + """, x AS (SELECT r.conv_id, list({'r': rank, 's': len(text)} ORDER BY rank) AS xs FROM r JOIN conversations USING (conv_id, turn) WHERE rank <= 3 AND score > 0 GROUP BY 1),
f AS (SELECT conv_id, list_reduce(xs, lambda acc, x: CASE WHEN acc.used + x.s <= 2000 THEN {'used': acc.used + x.s, 'taken': list_append(acc.taken, x.r)} ELSE acc END, {'used': 0::BIGINT, 'taken': []::BIGINT[]}) AS a FROM x),
k AS (SELECT conv_id, unnest(a.taken) AS rank FROM f)
SELECT conv_id || ':' || turn AS passage_id, conv_id, rank, round(score, 6) AS score FROM r JOIN k USING (conv_id, rank)""")
def pip_evidence_selection(t: Tables) -> DataFrame:
    """The evidence path end to end: eligibility, TF-IDF, top three, and a first-fit budget of characters."""
    top = ranked(t).where("score > 0").withColumn("size", F.length("content"))
    kept = select.first_fit(top, ["source_id"], "rank", "size", 2000)
    return kept.select(F.concat_ws(":", "source_id", "position").alias("passage_id"), F.col("source_id").alias("conv_id"), "rank", F.round("score", 6).alias("score"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query(f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), b AS (SELECT item_id, {WORDS.format('text')} AS q FROM benchmark)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT item_id, doc_id, len(list_intersect(w, q)) / greatest(1, len(list_distinct(list_concat(w, q)))) AS score FROM d, b) WHERE score >= 0.3""")
def txt_02_lexical(t: Tables) -> DataFrame:
    """Word-set overlap of every document with the stated query set, where it is large.

    A document at the threshold shares 0.3 of a query's words at least, so it has one of
    the query's rarest words, all but 0.3 of them and one more: documents meet queries on
    these only, if their sizes allow the threshold, and the pairs are verified by both word sets.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)))
    d, q = t.documents.select("doc_id", words("text").alias("w")), t.benchmark.select("item_id", words("text").alias("q"))
    index = d.select("doc_id", F.size("w").alias("n"), F.explode_outer("w").alias("word"))
    asked = q.select("item_id", F.size("q").alias("m"), F.explode_outer("q").alias("word"))
    df = index.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "word")) <= F.col("m") - F.ceil(F.lit(0.3) * F.col("m")) + 1
    prefix = asked.join(df, "word").select("item_id", "m", "word", rare.alias("rare")).where("rare").select("item_id", "m", "word")
    sizes = (F.col("n") >= 0.3 * F.col("m")) & (0.3 * F.col("n") <= F.col("m"))
    pairs = index.join(prefix, "word").where(sizes).select("item_id", "doc_id", "n", "m").distinct()
    shared = pairs.join(d, "doc_id").join(q, "item_id").select("item_id", "doc_id", "n", "m", F.size(F.array_intersect("w", "q")).alias("k"))
    score = F.col("k") / F.greatest(F.lit(1), F.col("n") + F.col("m") - F.col("k"))
    return shared.where(F.col("k") >= 0.3 * (F.col("n") + F.col("m") - F.col("k")) - 1e-9).select("item_id", "doc_id", score.alias("score")).where("score >= 0.3").select("item_id", "doc_id", F.round("score", 6).alias("score"))


QUERIES = "(SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0)"


def query_vectors(t: Tables) -> DataFrame:
    """The stated query set."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], query::DOUBLE[]), 6) AS score FROM embeddings, {QUERIES}")
def vec_01_scores(t: Tables) -> DataFrame:
    """Dot products of all vectors with the query set."""
    return retrieval.scored(t.embeddings, query_vectors(t)).select("query_id", "vec_id", F.round("score", 6).alias("score"))


KNN = "SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings{}, {}) WHERE rank <= 5"


@query(KNN.format("", QUERIES))
def vec_02_nearest(t: Tables) -> DataFrame:
    """The five nearest vectors of each query."""
    return retrieval.nearest(t.embeddings, query_vectors(t), 5).select("query_id", "vec_id", "rank")


@query()
def vec_03_embedding(t: Tables) -> DataFrame:
    """Hashing embeddings of all documents, and their length."""
    d = t.documents.select("doc_id", embed(F.col("text")).alias("e"))
    return d.select("doc_id", F.size("e").alias("dimension"), F.round(F.sqrt(retrieval.dot(F.col("e"), F.col("e"))), 4).alias("norm"))


@query("SELECT p_partkey, 'Mathematical expression: ' || p_name AS prompt FROM part")
def vec_04_latex_prompt(t: Tables) -> DataFrame:
    """The text that is embedded for an expression."""
    return t.part.select("p_partkey", latex_prompt(F.col("p_name")).alias("prompt"))


@query(KNN.format(" WHERE label <= 4", QUERIES).replace("FROM embeddings WHERE label <= 4, ", "FROM (SELECT * FROM embeddings WHERE label <= 4), "))
def vec_05_filtered_nearest(t: Tables) -> DataFrame:
    """The nearest among what the filter admits: filtered first, then ranked."""
    return retrieval.nearest(t.embeddings.where("label <= 4"), query_vectors(t), 5).select("query_id", "vec_id", "rank")


@query("SELECT vec_id, round(0.9 - 0.1 * (row_number() OVER (ORDER BY vec_id) - 1), 6) AS score FROM (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5)")
def vec_06_mock_search(t: Tables) -> DataFrame:
    """The first rows with falling scores: the offline stand-in of a store."""
    first = select.top_k(t.embeddings.select("vec_id", F.lit(1).alias("store")), ["store"], [F.col("vec_id")], 5)
    return first.select("vec_id", F.round(0.9 - 0.1 * (F.col("rank") - 1), 6).alias("score"))


HYBRID = f"""
WITH v AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) DESC, vec_id) AS ord FROM embeddings, {QUERIES} QUALIFY ord <= 20),
k AS (SELECT query_id, d.doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY d.doc_id) AS ord FROM documents d JOIN (SELECT doc_id AS query_id, source, lang FROM documents WHERE doc_id % 50 = 0) q ON d.source = q.source AND d.lang = q.lang AND d.doc_id < q.query_id WHERE contains(d.text, '=') QUALIFY ord <= 10),
g AS (SELECT query_id, id, 100 + ord AS ord FROM k WHERE query_id IN (SELECT query_id FROM {QUERIES})),
m AS (SELECT query_id, id, min(ord) AS ord, list(CASE WHEN ord <= 20 THEN 'vector' ELSE 'graph' END ORDER BY ord) AS via FROM (SELECT * FROM v UNION ALL SELECT * FROM g) GROUP BY ALL)
"""


def hybrid(t: Tables) -> DataFrame:
    """Per query: twice as many vector hits as wanted, and earlier documents with an equation of the same source and language, merged by id."""
    asked = query_vectors(t)
    v = retrieval.nearest(t.embeddings, asked, 20).select("query_id", F.col("vec_id").alias("id"), F.col("rank").alias("ord"), F.lit("vector").alias("via"))
    q = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "source", "lang").join(asked.select("query_id"), "query_id", "left_semi")
    met = t.documents.where(F.col("text").contains("=")).select(F.col("doc_id").alias("id"), "source", "lang").join(q, ["source", "lang"]).where("id < query_id")
    g = select.top_k(met, ["query_id"], [F.col("id")], 10).select("query_id", "id", (F.col("rank") + 100).alias("ord"), F.lit("graph").alias("via"))
    both = v.unionByName(g)
    entries = F.array_sort(F.collect_list(F.struct("ord", "via")))
    return both.groupBy("query_id", "id").agg(F.min("ord").alias("ord"), F.array_distinct(F.transform(entries, lambda x: x["via"])).alias("via"))


@query(HYBRID + "SELECT query_id, id, via FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ord) <= 10")
def ret_01_hybrid(t: Tables) -> DataFrame:
    """Vector and graph hits merged, the first ten of each query."""
    return select.top_k(hybrid(t), ["query_id"], [F.col("ord")], 10).select("query_id", "id", "via")


GRAPH_BRANCH = """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 7 = 0),
seed AS (SELECT DISTINCT part FROM e WHERE part % 50 = 0), d1 AS (SELECT s.part AS seed, a.supp FROM seed s JOIN e a ON a.part = s.part),
hits AS (SELECT part AS seed, part AS hit, 'seed' AS kind, 0 AS distance FROM seed UNION SELECT seed, e.part, 'expanded', 1 FROM d1 JOIN e USING (supp) WHERE e.part != seed)
SELECT seed, hit, kind, distance, round(CASE WHEN distance = 0 THEN 0.8 ELSE 0.7 - 0.1 * distance END, 6) AS score FROM hits"""


@query(GRAPH_BRANCH)
def ret_02_graph_scores(t: Tables) -> DataFrame:
    """The graph branch: seeds, and parts one step further over a supplier they share, with scores by kind and distance."""
    e = t.lineitem.where("l_linenumber = 1 AND l_orderkey % 7 = 0").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()
    seeds = e.where("part % 50 = 0").select(F.col("part").alias("seed")).distinct()
    near = e.join(seeds, F.col("part") == F.col("seed")).select("seed", "supp").join(e, "supp").where("part != seed").select("seed", F.col("part").alias("hit")).distinct()
    hits = seeds.select("seed", F.col("seed").alias("hit"), F.lit("seed").alias("kind"), F.lit(0).alias("distance")).unionByName(near.select("seed", "hit", F.lit("expanded").alias("kind"), F.lit(1).alias("distance")))
    score = F.when(F.col("distance") == 0, 0.8).otherwise(0.7 - 0.1 * F.col("distance"))
    return hits.select("seed", "hit", "kind", "distance", F.round(score, 6).alias("score"))


@query(HYBRID + ", x AS (SELECT query_id, id, via, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ord = best THEN 0 ELSE 1 END, ord) AS rank FROM m LEFT JOIN (SELECT query_id, min(ord) AS best FROM m WHERE list_contains(via, 'graph') GROUP BY 1) USING (query_id)) SELECT query_id, id, via, rank FROM x WHERE rank <= 8")
def ret_03_scoped_hybrid(t: Tables) -> DataFrame:
    """The same with a slot kept for each query's best hit of the rule channel."""
    best = F.min(F.when(F.array_contains("via", "graph"), F.col("ord"))).over(Window.partitionBy("query_id"))
    slotted = hybrid(t).withColumn("slot", F.when(F.col("ord") == best, 0).otherwise(1))
    return select.top_k(slotted, ["query_id"], [F.col("slot"), F.col("ord")], 8).select("query_id", "id", "via", "rank")


@query("SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings e JOIN (SELECT vec_id AS query_id, embedding AS query, label AS chapter FROM embeddings WHERE vec_id % 50 = 0) q ON label <= chapter) WHERE rank <= 3")
def ret_04_by_chapter(t: Tables) -> DataFrame:
    """Nearest vectors up to each query's own chapter."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("chapter"))
    return retrieval.nearest(t.embeddings, q, 3, limit=("label", "chapter")).select("query_id", "vec_id", "rank")


@query("SELECT d.doc_id, coalesce(quality::DOUBLE, 0.5) AS score FROM documents d LEFT JOIN labels USING (doc_id)")
def ret_05_default_score(t: Tables) -> DataFrame:
    """A score for every hit, 0.5 where the store gave none."""
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("score"))


@query(r"SELECT conv_id, turn, CASE WHEN contains(lower(text), 'prerequisite') OR contains(lower(text), 'require') OR len(regexp_extract_all(text, '\S+')) > 15 THEN 'step_back' WHEN regexp_matches(lower(text), 'difference|compare|explain') THEN 'hyde' ELSE 'direct' END AS policy FROM conversations WHERE role = 'user'")
def ret_06_refinement(t: Tables) -> DataFrame:
    """How a question would be rewritten before retrieval."""
    low = F.lower("text")
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    policy = F.when(contains_any(low, ["prerequisite", "require"]) | (words > 15), "step_back").when(contains_any(low, ["difference", "compare", "explain"]), "hyde").otherwise("direct")
    return t.conversations.where("role = 'user'").select("conv_id", "turn", policy.alias("policy"))


@query("SELECT conv_id, array_to_string(list('[' || turn || '] ' || substr(text, 1, 600) ORDER BY turn), chr(10)) AS context FROM conversations GROUP BY 1")
def ret_08_context(t: Tables) -> DataFrame:
    """The context text of each source, numbered."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 600).alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), r["turn"].cast("string"), F.lit("] "), r["x"])), "\n").alias("context"))


@query(f"SELECT count(*) AS n FROM documents WHERE NOT regexp_matches(text, '{EXAMPLE_SQL}')")
def ret_09_without_examples(t: Tables) -> DataFrame:
    """Candidates that retrieval may return."""
    return t.documents.where(~is_worked_example(F.col("text"))).agg(F.count(F.lit(1)).alias("n"))
