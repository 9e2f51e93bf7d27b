"""Sources and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corpus, runs
from ..sources import records as r
from ..sources import sinks
from .registry import Tables, query, spread


def count() -> Column:
    """The number of rows."""
    return F.count(F.lit(1))



@query("SELECT doc_id, source FROM documents")
def src_01_unique_records(t: Tables) -> DataFrame:
    """Records after the check that ids are unique."""
    return r.require_unique(t.documents, "doc_id").select("doc_id", "source")


@query("SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS position FROM conversations")
def src_02_global_positions(t: Tables) -> DataFrame:
    """Positions over all modules from positions within each."""
    within = t.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ordinal"))
    return r.global_positions(within, "conv_id", "ordinal").select("conv_id", "turn", "position")


def modules(t: Tables) -> DataFrame:
    """Book modules written from parts: a paragraph with formulas, a note with media, an exercise with its solution, and one with an element that can't be shown."""
    c = lambda n: F.col(n).cast("string")
    parts = (
        "<document xmlns='urn:c' xmlns:m='urn:m'><content><para id='p'>The ", c("p_name"), "\n  is <m:math><m:mfrac><m:mn>", c("p_size"), "</m:mn><m:msup><m:mi>x</m:mi><m:mn>2</m:mn></m:msup></m:mfrac></m:math>",
        " of <link target-id='n'/>.</para><section><note id='n'>See <media/> or <m:math><m:msqrt><m:mi>y</m:mi></m:msqrt></m:math></note></section><section class='section-exercises'><exercise id='e'><problem>Find ",
        c("p_brand"), ".</problem><solution>Hidden.</solution></exercise></section><equation id='q'><m:math><m:", F.when(F.col("p_size") > 25, "mroot").otherwise("menclose"), "><m:mn>8</m:mn><m:mn>3</m:mn></m:",
        F.when(F.col("p_size") > 25, "mroot").otherwise("menclose"), "></m:math></equation></content></document>",
    )
    return t.part.select(c("p_partkey").alias("module_id"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("xml"))


@query("""
SELECT p_partkey::VARCHAR AS module_id, o::INT AS ordinal, ['para', 'note', 'exercise', 'equation'][o + 1] AS kind, ['p', 'n', 'e', 'q'][o + 1] AS anchor,
  CASE o WHEN 0 THEN 'The ' || p_name || ' is ((' || p_size || ')/((x)^(2))) of [reference:#n].' WHEN 1 THEN 'See [unrendered-media] or sqrt(y)' WHEN 2 THEN 'Find ' || p_brand || '.' ELSE CASE WHEN p_size > 25 THEN 'root(3, 8)' ELSE '83' END END AS content,
  CASE WHEN o = 3 AND p_size <= 25 THEN ['menclose'] ELSE [] END AS unsupported, CASE WHEN o = 2 THEN 'exercise_material' ELSE 'instruction' END AS role
FROM part, range(4) r(o)""")
def src_03_module_text(t: Tables) -> DataFrame:
    """Blocks of book modules in document order, formulas in one line, exercises without their solutions."""
    return r.extract_modules(modules(t))


@query("SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, contains(html, '<img') OR contains(html, '<video') AS has_media FROM pages")
def src_03_page_structure(t: Tables) -> DataFrame:
    """Paragraphs of a page, and whether it needs media."""
    html = F.col("html")
    return t.pages.select("page_id", F.regexp_count(html, F.lit("<p[ >]")).alias("paragraphs"), (html.contains("<img") | html.contains("<video")).alias("has_media"))


@query("""
SELECT p_partkey, x.n::INT AS span, (x.n * 10)::DOUBLE AS "left", p_size::DOUBLE AS width, CASE WHEN x.n * 10 + p_size <= 40 THEN 'inside' ELSE 'clipped' END AS state
FROM part, (VALUES (0), (1), (2)) x(n) WHERE x.n * 10 < 40""")
def src_11_crop(t: Tables) -> DataFrame:
    """Spans of pages in XML, and how they lie to a region."""
    c = lambda n: F.col(n).cast("string")
    span = lambda n: (f"<text left='{n * 10}' top='5' width='", c("p_size"), f"' height='4'>t{n}</text>")
    parts = ("<page>", *span(0), *span(1), *span(2), "<text left='90' top='5' width='3' height='4'>out</text></page>")
    xml = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    spans = spread(t.part).select("p_partkey", F.explode(r.page_spans(xml)).alias("s")).select("p_partkey", "s.*")
    return r.crop(spans, (0, 0, 40, 20)).select("p_partkey", F.substring("content", 2, 1).cast("int").alias("span"), "left", "width", "state")


@query("SELECT count(*) AS rows, true AS written, false AS written_again, true AS refused FROM orders")
def snk_09_frozen(t: Tables) -> DataFrame:
    """A table that is frozen: the same rows change nothing, others are refused."""
    from ..operators.rounds import shared_folder
    from ..sources.sinks import write_frozen

    path = shared_folder(t.spark, "frozen")
    rows = t.orders.select("o_orderkey", "o_totalprice")
    first, again = write_frozen(rows, path), write_frozen(rows.orderBy("o_totalprice"), path)
    try:
        refused = not write_frozen(rows.withColumn("o_totalprice", -F.col("o_totalprice")), path)
    except ValueError:
        refused = True
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(first).alias("written"), F.lit(again).alias("written_again"), F.lit(refused).alias("refused"))


@query("SELECT d.doc_id, CASE WHEN quality = 1 THEN 'instruction' WHEN quality IS NOT NULL THEN 'exercise_material' ELSE 'unknown' END AS role FROM documents d LEFT JOIN labels USING (doc_id)")
def src_05_roles(t: Tables) -> DataFrame:
    """Records with their structural role, unknown where there is none."""
    role = F.when(F.col("quality") == 1, "instruction").when(F.col("quality").isNotNull(), "exercise_material").otherwise("unknown")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", role.alias("role"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM l),
s AS (SELECT doc_id, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i - 1], lambda v: len(v) + 1)), 0) AS pos FROM u)
SELECT doc_id, trim(line, ' ') AS content, (pos + len(line) - len(ltrim(line, ' ')))::BIGINT AS "start", (pos + len(line) - len(ltrim(line, ' ')) + len(trim(line, ' ')))::BIGINT AS "end" FROM s WHERE trim(line, ' ') != ''""")
def src_08_line_spans(t: Tables) -> DataFrame:
    """Lines with exact character offsets."""
    return t.documents.select("doc_id", F.explode(r.line_spans(F.col("text"))).alias("s")).select("doc_id", "s.content", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("SELECT page_id FROM pages WHERE contains(html, '<p') OR contains(html, '<title')")
def src_22_nodes_with_text(t: Tables) -> DataFrame:
    """Nodes that have some text."""
    return t.pages.where(F.col("html").contains("<p") | F.col("html").contains("<title")).select("page_id")


@query("SELECT p_partkey, coalesce(nullif(p_name, 'small ring'), p_type) AS statement FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size = 7 ORDER BY p_size, p_partkey")
def src_23_targets(t: Tables) -> DataFrame:
    """Targets of some kinds and one chapter, with the first text they have."""
    picked = t.part.where(F.col("p_type").isin("ECONOMY", "PROMO") & (F.col("p_size") == 7)).orderBy("p_size", "p_partkey")
    return picked.select("p_partkey", F.coalesce(F.nullif("p_name", F.lit("small ring")), "p_type").alias("statement"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def src_24_resume(t: Tables) -> DataFrame:
    """What hasn't been processed yet."""
    return t.orders.join(t.lineitem.where("l_quantity > 30"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


RUN_SQL = """
e AS (SELECT doc_id AS k, md5(text) AS payload, CASE WHEN regexp_matches(text, '[&%$#|]{3}') THEN 0 ELSE 1 END AS replayed FROM documents),
a AS (SELECT l.doc_id AS k, md5(trim(regexp_replace(d.text, ' {2,}', ' ', 'g'), ' ')) AS payload, quality FROM labels l LEFT JOIN documents d USING (doc_id))"""


@query(f"""WITH {RUN_SQL}
SELECT coalesce(e.k, a.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN a.payload IS DISTINCT FROM e.payload THEN 'payload' WHEN quality IS DISTINCT FROM replayed THEN 'decision' ELSE 'ok' END AS state
FROM e FULL JOIN a ON e.k = a.k""")
def src_25_saved_run(t: Tables) -> DataFrame:
    """A saved run (labels) against what it was to be: every key once, the same payload, decisions that can be replayed."""
    replayed = F.when(F.col("text").rlike(r"[&%$#|]{3}"), 0).otherwise(1)
    expected = t.documents.select(F.col("doc_id").alias("key"), F.md5(F.col("text").cast("binary")).alias("payload"), replayed.alias("decision"))
    clean = F.trim(F.regexp_replace("text", " {2,}", " "))
    actual = t.labels.join(t.documents, "doc_id", "left").select(F.col("doc_id").alias("key"), F.md5(clean.cast("binary")).alias("payload"), F.col("quality").alias("decision"))
    return runs.check_run(expected, actual).withColumnRenamed("key", "doc_id")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS unexpected FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def src_25_run_keys(t: Tables) -> DataFrame:
    """Keys of a saved run against the expected ones."""
    d, l = t.documents.select("doc_id", F.lit(1).alias("d")), t.labels.select("doc_id", F.lit(1).alias("l"))
    return d.join(l, "doc_id", "full").agg(F.count_if(F.col("l").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("unexpected"))


@query("SELECT lang, min(doc_id) AS doc_id, count(*) AS fitting FROM documents WHERE n_chars BETWEEN 40 AND 1600 AND NOT contains(text, '###') GROUP BY 1")
def src_27_pilot_filter(t: Tables) -> DataFrame:
    """Sources that fit, and the first of each group."""
    fits = F.col("n_chars").between(40, 1600) & ~F.col("text").contains("###")
    return t.documents.where(fits).groupBy("lang").agg(F.min("doc_id").alias("doc_id"), count().alias("fitting"))


@query(r"""
SELECT conv_id, turn, CASE WHEN NOT contains(text, '?') THEN last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w END AS context_turn,
  list_filter([CASE WHEN NOT contains(text, '?') AND last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w IS NULL THEN 'no_instruction' END, CASE WHEN len(text) < 40 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda v: v IS NOT NULL) AS issues
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def src_28_target_context(t: Tables) -> DataFrame:
    """The last instruction before each record of its source, unless it asks for something itself; and what is wrong with the record."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = t.conversations.select("conv_id", "turn", "text", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before).alias("last"))
    asks = F.col("text").contains("?")
    issues = F.array(F.when(~asks & F.col("last").isNull(), F.lit("no_instruction")), F.when(F.length("text") < 40, F.lit("short")), F.when(F.col("text").contains("|"), F.lit("table")))
    return last.select("conv_id", "turn", F.when(~asks, F.col("last")).alias("context_turn"), F.array_sort(F.array_compact(issues)).alias("issues"))


@query("SELECT doc_id, CASE WHEN (len(text) - len(replace(text, '###', ''))) / 3 = 1 THEN instr(text, '###') - 1 END AS place FROM documents")
def src_31_locate(t: Tables) -> DataFrame:
    """The place of an anchor that occurs exactly once."""
    return t.documents.select("doc_id", r.locate_once(F.col("text"), F.lit("###")).cast("long").alias("place"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_mktsegment END AS segment, c_name AS name FROM customer")
def snk_01_upsert(t: Tables) -> DataFrame:
    """Nodes merged with an update: later properties win, others stay."""
    props = lambda *kv: F.create_map(*kv).alias("props")
    old = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0).alias("seq"), props(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name"))
    new = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("seq"), props(F.lit("segment"), F.lit("updated")))
    return sinks.upsert(old, new, "id", "seq").select("id", F.col("props")["segment"].alias("segment"), F.col("props")["name"].alias("name"))


@query("SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def snk_02_edges(t: Tables) -> DataFrame:
    """Edges of which both ends exist, each once."""
    edges = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return edges.join(t.customer.where("c_acctbal > 0"), F.col("src") == F.col("c_custkey"), "left_semi").distinct()


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def snk_03_unique_audit(t: Tables) -> DataFrame:
    """Keys that a uniqueness constraint would refuse."""
    return t.part.groupBy("p_name").agg(count().alias("n")).where("n > 1")


@query("SELECT vec_id, sha256('v' || vec_id) AS id, len(embedding)::INT AS dimension, label::VARCHAR AS chapter FROM embeddings")
def snk_04_vector_rows(t: Tables) -> DataFrame:
    """Rows of a vector collection with stable ids and metadata."""
    rows = t.embeddings.select("vec_id", F.sha2(F.concat(F.lit("v"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("id"), "embedding", F.create_map(F.lit("chapter"), F.col("label").cast("string")).alias("metadata"))
    return rows.select("vec_id", "id", F.size("embedding").alias("dimension"), F.col("metadata")["chapter"].alias("chapter"))


@query("SELECT p_type || '_ch' || p_size || '_' || p_partkey AS id, '[' || p_type || '] ' || p_name AS content FROM part WHERE len('[' || p_type || '] ' || p_name) > 20")
def snk_05_hydrate(t: Tables) -> DataFrame:
    """Graph nodes as documents for the vector store."""
    content = F.concat(F.lit("["), "p_type", F.lit("] "), "p_name")
    ids = F.concat("p_type", F.lit("_ch"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string"))
    return t.part.where(F.length(content) > 20).select(ids.alias("id"), content.alias("content"))


@query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ', ') AS roles FROM conversations GROUP BY 1")
def snk_11_joined_metadata(t: Tables) -> DataFrame:
    """List metadata as one string."""
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("roles"))


@query("SELECT lower(p_name) AS norm, arg_min(p_name, p_partkey) AS name, list_sort(list(DISTINCT p_brand)) AS sources FROM part GROUP BY 1")
def snk_12_merge_concepts(t: Tables) -> DataFrame:
    """Concepts merged by normalised name: the first name stays, sources are collected."""
    return t.part.groupBy(F.lower("p_name").alias("norm")).agg(F.min_by("p_name", "p_partkey").alias("name"), F.array_sort(F.collect_set("p_brand")).alias("sources"))


@query("SELECT lower(trim(n_name)) AS concept, lower(trim(r_name)) AS topic FROM nation JOIN region ON n_regionkey = r_regionkey")
def snk_14_named_edges(t: Tables) -> DataFrame:
    """Relations between nodes found by normalised name."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower(F.trim("n_name")).alias("concept"), F.lower(F.trim("r_name")).alias("topic"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE 'GROUNDED_IN' END AS type FROM part")
def snk_20_known_types(t: Tables) -> DataFrame:
    """Types outside the known ones fall back to a default."""
    return t.part.select("p_partkey", F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.col("p_type")).otherwise("GROUNDED_IN").alias("type"))


@query(r"""
WITH p AS (SELECT d.doc_id, sha256(regexp_replace(d.text, '[&%$#*]{3}', '', 'g')) AS h, CASE WHEN quality = 1 THEN 'instruction' ELSE 'exercise_material' END AS role FROM documents d JOIN labels USING (doc_id))
SELECT d.doc_id, coalesce(role, 'unknown') AS role, CASE WHEN h IS NULL THEN 'unpinned' WHEN h = sha256(text) THEN 'ok' ELSE 'changed' END AS state FROM documents d LEFT JOIN p USING (doc_id)""")
def src_05_checked_records(t: Tables) -> DataFrame:
    """Records with their role, and whether they are still what was pinned: their text without runs of signs."""
    own = t.documents.join(t.labels, "doc_id")
    pins = own.select(F.col("doc_id").alias("id"), F.sha2(F.regexp_replace("text", "[&%$#*]{3}", "").cast("binary"), 256).alias("sha256"))
    anchors = own.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "instruction").otherwise("exercise_material").alias("role"))
    records = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return corpus.with_structure(records, anchors, pins).select(F.col("id").alias("doc_id"), "role", "state")
