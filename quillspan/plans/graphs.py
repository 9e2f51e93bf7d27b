"""Joins and graph traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph
from ..operators.retrieval import contained
from .registry import Tables, query

#: Parts as a graph: each part needs the part at half its key and the one at a third.
EDGE_SQL = "SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 3 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0"


def part_edges(t: Tables) -> DataFrame:
    part = t.part.where("p_partkey > 0")
    return part.selectExpr("p_partkey div 2 AS src", "p_partkey AS dst").unionAll(part.selectExpr("p_partkey div 3 AS src", "p_partkey AS dst"))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def joi_01_lookup(t: Tables) -> DataFrame:
    """Keyed lookup of evidence in a catalog."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query(f"""
WITH RECURSIVE e AS ({EDGE_SQL}), walk AS (
  SELECT p_partkey AS start, p_partkey AS node, 0 AS distance, [p_partkey] AS path_ids FROM part WHERE p_size = 50
  UNION ALL
  SELECT start, e.src, distance + 1, list_append(path_ids, e.src) FROM walk JOIN e ON e.dst = walk.node
  WHERE distance < 2 AND len(list_filter(range(1, len(path_ids)), lambda i: path_ids[i] = e.dst AND path_ids[i + 1] = e.src)) = 0
)
SELECT start, node, distance, path_ids FROM walk WHERE distance > 0""")
def joi_02_prerequisites(t: Tables) -> DataFrame:
    """All paths of one or two edges back from the starts."""
    return graph.expand_back(part_edges(t), t.part.where("p_size = 50").select(F.col("p_partkey").alias("start")), 2)


@query("SELECT n_name, s_suppkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 0")
def joi_03_misconceptions(t: Tables) -> DataFrame:
    """One hop along one type of edge."""
    return t.supplier.where("s_acctbal < 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name")


@query(f"""
WITH e AS (SELECT DISTINCT src, dst FROM ({EDGE_SQL})), s AS (SELECT p_partkey AS id FROM part WHERE p_size = 49)
SELECT id, dst AS neighbour, true AS outgoing FROM e JOIN s ON src = id
UNION ALL SELECT id, src, false FROM e JOIN s ON dst = id WHERE src != dst""")
def joi_04_neighbours(t: Tables) -> DataFrame:
    """Undirected one-hop expansion from seeds."""
    edges = part_edges(t).distinct().withColumn("type", F.lit("NEEDS"))
    return graph.neighbours(edges, t.part.where("p_size = 49").select(F.col("p_partkey").alias("id"))).drop("type")


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({EDGE_SQL})), reach AS (
  SELECT p_partkey AS start, p_partkey AS node, 0 AS d FROM part WHERE p_size = 48
  UNION SELECT start, src, d + 1 FROM reach JOIN e ON dst = node WHERE d < 3)
SELECT start, node, min(d) AS distance FROM reach GROUP BY ALL""")
def joi_05_reachable(t: Tables) -> DataFrame:
    """What references reach within three steps, with the least distance."""
    edges = part_edges(t).distinct()
    seen = t.part.where("p_size = 48").select(F.col("p_partkey").alias("start"), F.col("p_partkey").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for d in (1, 2, 3):
        front = front.join(edges, F.col("node") == F.col("dst")).select("start", F.col("src").alias("node"), F.lit(d).alias("distance")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("start", "node").agg(F.min("distance").alias("distance"))


@query("""
SELECT a.n_name AS a_name, b.n_name AS b_name, kind FROM nation a JOIN nation b ON a.n_name != b.n_name
JOIN (VALUES (0, 1, 'REQUIRES'), (1, 2, 'DEFINES'), (2, 0, 'USES')) r(l, m, kind) ON a.n_regionkey = l AND b.n_regionkey = m""")
def joi_07_candidate_pairs(t: Tables) -> DataFrame:
    """Pairs whose roles fit a relation: equi-joins on the roles, never all pairs."""
    roles = t.spark.createDataFrame([(0, 1, "REQUIRES"), (1, 2, "DEFINES"), (2, 0, "USES")], "l int, m int, kind string")
    a = t.nation.select(F.col("n_name").alias("a_name"), F.col("n_regionkey").alias("l"))
    b = t.nation.select(F.col("n_name").alias("b_name"), F.col("n_regionkey").alias("m"))
    return a.join(F.broadcast(roles), "l").join(b, "m").where("a_name != b_name").select("a_name", "b_name", "kind")


@query("SELECT s.s_suppkey, p.p_partkey FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 20) s, (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 30) p")
def joi_08_first_pairs(t: Tables) -> DataFrame:
    """The first 20 of one source with the first 30 of another."""
    return t.supplier.select("s_suppkey").orderBy("s_suppkey").limit(20).crossJoin(F.broadcast(t.part.select("p_partkey").orderBy("p_partkey").limit(30)))


@query(r"""
WITH n AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) AS norm, p_brand AS source FROM part)
SELECT norm, count(*)::BIGINT AS members, list_sort(list(DISTINCT source)) AS sources FROM n GROUP BY norm HAVING count(DISTINCT source) > 1""")
def joi_09_same_names(t: Tables) -> DataFrame:
    """Names that several sources share: one row per name with its members, not one per pair."""
    norm = F.trim(F.regexp_replace(F.lower("p_name"), r"\s+", " "))
    g = t.part.groupBy(norm.alias("norm")).agg(F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("p_brand")).alias("sources"))
    return g.where(F.size("sources") > 1)


@query("""
WITH s AS (SELECT conv_id, turn FROM conversations WHERE len(text) > 600)
SELECT DISTINCT c.conv_id, c.turn FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn - s.turn BETWEEN -2 AND 2""")
def joi_10_adjacent_context(t: Tables) -> DataFrame:
    """Turns within two places of a seed: each seed names its places, so the band is an equi-join."""
    places = t.conversations.where(F.length("text") > 600).select("conv_id", F.explode(F.sequence(F.col("turn") - 2, F.col("turn") + 2)).alias("turn")).distinct()
    return t.conversations.join(places, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("""
SELECT p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON p.user_id = s.user_id AND s.ts < p.ts""")
def joi_11_as_of(t: Tables) -> DataFrame:
    """The user's last signup before each purchase."""
    e = t.events.where(F.col("event_type").isin("purchase", "signup"))
    before = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp"), F.col("event_type") == "signup", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    signup = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(before)
    return e.withColumn("signup_id", signup).where("event_type = 'purchase'").select("event_id", "signup_id")


@query("""
WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id, list(text ORDER BY turn) AS y FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, len(x)::INT AS user_turns, len(y)::INT AS assistant_turns, x = y AS same FROM a JOIN b USING (conv_id)""")
def joi_12_arm_pairs(t: Tables) -> DataFrame:
    """Complete pairs of two arms and whether their ordered contexts agree."""
    side = lambda role, name: t.conversations.where(F.col("role") == role).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias(name))
    return side("user", "x").join(side("assistant", "y"), "conv_id").select("conv_id", F.size("x").alias("user_turns"), F.size("y").alias("assistant_turns"), (F.col("x") == F.col("y")).alias("same"))


@query("SELECT l_returnflag AS type, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def joi_13_coverage(t: Tables) -> DataFrame:
    """Edges with two eligible ends by type."""
    edges = t.lineitem.join(t.part.where("p_size <= 25"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t.supplier.where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return edges.groupBy(F.col("l_returnflag").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH want AS (SELECT conv_id, role FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('user'), ('assistant'), ('system')) r(role)),
have AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, role, CASE WHEN n IS NULL THEN 'missing' WHEN want.conv_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS state FROM want FULL JOIN have USING (conv_id, role)""")
def joi_14_key_coverage(t: Tables) -> DataFrame:
    """Expected keys against found ones."""
    have = t.conversations.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    want = t.conversations.select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, ("user", "assistant", "system")))).alias("role"), F.lit(True).alias("wanted"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated").otherwise("ok")
    return want.join(have, ["conv_id", "role"], "full").select("conv_id", "role", state.alias("state"))


@query("""
SELECT item_id, doc_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + len(b.text) AS "end", sha256(b.text) AS digest
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def joi_15_quote_spans(t: Tables) -> DataFrame:
    """First place of each benchmark passage in each document that holds it."""
    pairs = contained(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("quote")))
    start = (F.expr("instr(text, quote)") - 1).cast("long")
    return pairs.select("item_id", "doc_id", start.alias("start"), (start + F.length("quote")).alias("end"), F.sha2(F.col("quote").cast("binary"), 256).alias("digest"))


@query("""
WITH f AS (SELECT item_id, count(*) AS n, bool_and(quality = 1) AS good FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT b.item_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'uncited' WHEN n > 1 THEN 'repeated' WHEN good THEN 'sound' ELSE 'unlabelled_or_low' END AS state FROM benchmark b LEFT JOIN f USING (item_id)""")
def joi_16_citation_evidence(t: Tables) -> DataFrame:
    """For each passage, how often it is cited and by what."""
    pairs = contained(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("quote"))).select("item_id", "doc_id")
    f = pairs.join(t.labels, "doc_id", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("quality") == 1).alias("good"))
    state = F.when(F.col("n").isNull(), "uncited").when(F.col("n") > 1, "repeated").when(F.col("good"), "sound").otherwise("unlabelled_or_low")
    return t.benchmark.join(f, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, '') || CASE WHEN len(coalesce(p_name, '')) < 12 THEN ' ' || p_type ELSE '' END AS content FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def joi_17_enrichment(t: Tables) -> DataFrame:
    """Text of a referenced node, with more of it where it is short."""
    name = F.coalesce("p_name", F.lit(""))
    more = F.when(F.length(name) < 12, F.concat(F.lit(" "), "p_type")).otherwise("")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.concat(name, more).alias("content"))
