"""Structure of sources, on documents written from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textfn
from ..sources import layout
from .claims import words
from .registry import Tables, query


@query("""SELECT 'c' || n_nationkey AS collection_id, o::INT AS module_order, CASE o WHEN 0 THEN 'preface' WHEN 3 THEN 'index' ELSE 'm' || (n_nationkey + o) END AS module_id,
  (CASE WHEN o IN (0, 3) THEN 0 ELSE o END)::INT AS chapter FROM nation, range(4) r(o)""")
def src_04_module_order(t: Tables) -> DataFrame:
    """Modules of collections with their chapters."""
    chapter = lambda n: words("<subcollection><title/><content><module document='m", F.col("n_nationkey") + n, "'/></content></subcollection>")
    xml = words("<collection xmlns='urn:c'><content><module document='preface'/>", chapter(1), chapter(2), "<module document='index'/></content></collection>")
    return layout.module_order(t.nation.select(words("c", F.col("n_nationkey")).alias("collection_id"), xml.alias("xml")))


def modules(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    xml = words("<doc id='d'><para id='a'>See <link target-id='", F.when(key % 3 == 0, "fig").when(key % 3 == 1, "b").otherwise("gone"), "'/></para><para id='b'>x</para><section class='x section-exercises'><exercise id='e'><problem id='p'/></exercise></section><figure id='fig'/></doc>")
    return t.nation.select(key.cast("string").alias("module_id"), xml.alias("xml"))


@query("SELECT n_nationkey::VARCHAR AS module_id, a AS anchor, CASE WHEN a IN ('e', 'p') THEN 'exercise_material' ELSE 'exposition' END AS role, a = 'd' AS has_tasks FROM nation, (VALUES ('d'), ('a'), ('b'), ('e'), ('p'), ('fig')) v(a)")
def src_06_anchor_roles(t: Tables) -> DataFrame:
    """Roles of anchors by what they lie in."""
    return layout.anchors(modules(t)).select("module_id", "anchor", "role", "has_tasks")


@query("SELECT n_nationkey::VARCHAR AS module_id, a AS anchor, a IN ('a', 'd') AND n_nationkey % 3 != 1 AS external FROM nation, (VALUES ('d'), ('a'), ('b'), ('e'), ('p'), ('fig')) v(a)")
def src_07_external_media(t: Tables) -> DataFrame:
    """Anchors that refer to visuals or to other modules."""
    return layout.anchor_flags(modules(t)).select("module_id", "anchor", "external")


@query("SELECT p_partkey AS page_id, l::INT AS line, CASE l WHEN 0 THEN 'x^(' || p_size || ') = y' ELSE 'next' END AS content FROM part, range(2) r(l)")
def src_14_page_lines(t: Tables) -> DataFrame:
    """Lines of pages with exponents."""
    size = F.col("p_size").cast("string")
    span = lambda left, top, height, font, text: F.struct(F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(5.0).alias("width"), F.lit(height).alias("height"), F.lit(font).alias("font_size"), text.alias("content"))
    spans = F.array(span(0.0, 30.0, 10.0, 10.0, F.lit("next")), span(20.0, 10.0, 10.0, 10.0, F.lit("= y")), span(5.0, 10.0, 6.0, 6.0, size), span(0.0, 10.0, 10.0, 10.0, F.lit("x")))
    return layout.page_lines(t.part.select(F.col("p_partkey").cast("long").alias("page_id"), F.explode(spans).alias("s")).select("page_id", "s.*"))


@query("""SELECT p_partkey, e::VARCHAR AS example, CASE e WHEN 1 THEN 0 ELSE 32 + len(p_name) END::INT AS "start", CASE e WHEN 1 THEN 12 + len(p_name) ELSE 47 + len(p_name) END::INT AS "end", e::INT AS page
FROM part, (VALUES (1), (2)) v(e) WHERE p_size % 2 = 0 OR e = 1""")
def src_29_worked_examples(t: Tables) -> DataFrame:
    """Worked examples with a marked solution; a second one has none in every other text."""
    text = words("Example 1: ", F.col("p_name"), "\nSolution: it is so.\f", "Example 2: abc\n", F.when(F.col("p_size") % 2 == 0, "Solution").otherwise("Nothing"), "\nExample 1: again\nSolution")
    return layout.worked_examples(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""SELECT n_nationkey, q AS quantity, s AS symbol, (len(n_name) + a)::INT AS "start", (len(n_name) + b)::INT AS "end" FROM nation, (VALUES ('current', 'I', 1, 12), ('voltage', 'V', 17, 34)) v(q, s, a, b)""")
def scf_16_symbol_mentions(t: Tables) -> DataFrame:
    """Quantities named together with their symbols."""
    text = words(F.col("n_name"), " current (I) and V for the voltage.")
    return t.nation.select("n_nationkey", F.explode(layout.mentions_column(text)).alias("m")).select("n_nationkey", "m.*")


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, substr(sha256(lower('doc:' || doc_id || ':' || (i - 1))), 1, 16) AS chunk_id, len(p[i])::INT AS size
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(p[i], ' ') != ''""")
def pip_16_page_chunks(t: Tables) -> DataFrame:
    """Paragraphs of pages as chunks with stable ids; blank ones go, ids keep the places."""
    parts = t.documents.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: F.trim(x["p"]) != "")).alias("chunk_index", "x"))
    return parts.select("doc_id", "chunk_index", textfn.digest_id(F.lit("doc"), F.col("doc_id").cast("string"), F.col("x.i").cast("string")).alias("chunk_id"), F.length("x.p").alias("size"))


@query("""SELECT substr(sha256(lower('part:' || p_name || ':' || p_brand)), 1, 16) AS id, p_brand AS source, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY p_name, p_brand""")
def snk_07_extraction_ids(t: Tables) -> DataFrame:
    """Nodes under ids made of type, name and source: equal ones are one node."""
    return t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n")).select(textfn.digest_id(F.lit("part"), F.col("p_name"), F.col("p_brand")).alias("id"), F.col("p_brand").alias("source"), "first_key", "n")


@query("SELECT p_type AS concept, p_brand AS misconception, min(p_partkey) AS first_key FROM part GROUP BY 1, 2")
def snk_13_seeded_edges(t: Tables) -> DataFrame:
    """Edges between concepts and misconceptions, each once however often it is seeded."""
    seeds = t.part.select(F.col("p_type").alias("concept"), F.col("p_brand").alias("misconception"), "p_partkey")
    return seeds.unionAll(seeds).groupBy("concept", "misconception").agg(F.min("p_partkey").alias("first_key"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) = count(DISTINCT doc_id) AS reviewed_once FROM documents GROUP BY 1")
def snk_19_lock(t: Tables) -> DataFrame:
    """What an evaluation locks of each source, and whether every case is there once."""
    once = t.documents.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_chars").alias("chars"))
    return once.groupBy("source").agg(F.sum("times").alias("n"), F.sum("chars").alias("chars"), (F.max("times") == 1).alias("reviewed_once"))


@query(r"SELECT page_id, coalesce(NOT regexp_matches(html, '\\begin\{|\\end\{|\\[a-zA-Z]+\[|&&|\\\\'), true) AS usable FROM pages")
def scf_11_symbolic_readable(t: Tables) -> DataFrame:
    """Formulas without what a symbolic reader refuses."""
    return t.pages.select("page_id", F.coalesce(~F.col("html").rlike(r"\\begin\{|\\end\{|\\[a-zA-Z]+\[|&&|\\\\"), F.lit(True)).alias("usable"))
