"""Scope and eligibility filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scope
from ..operators.corpus import conversation_records, eligible_records, last_turns
from .registry import Tables, query


@query("""
WITH t AS (SELECT conv_id, max(turn) AS position FROM conversations GROUP BY conv_id)
SELECT c.conv_id || ':' || t.position AS target_id, c.conv_id || ':' || c.turn AS id, c.turn AS position
FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn < t.position
WHERE trim(regexp_replace(coalesce(c.text, ''), '\\s+', ' ', 'g')) != ''""".replace("\\\\", "\\"))
def flt_01_eligible(t: Tables) -> DataFrame:
    """Records a target may see: same source, earlier, not blank."""
    return eligible_records(conversation_records(t.conversations), last_turns(t.conversations)).select("target_id", "id", "position")


SPANS = "SELECT doc_id, source, doc_id * 10 AS s, doc_id * 10 + n_chars AS e FROM documents"


@query(f"SELECT doc_id, e - s AS width FROM ({SPANS}) WHERE source = 'src0' AND s >= 0 AND s < e AND e <= 5000")
def flt_02_scope(t: Tables) -> DataFrame:
    """Spans of one source that end before a position."""
    d = t.documents.select("doc_id", "source", (F.col("doc_id") * 10).alias("s"), (F.col("doc_id") * 10 + F.col("n_chars")).alias("e"))
    return d.where(scope.in_scope(F.col("source"), F.col("s"), F.col("e"), F.lit("src0"), F.lit(5000))).select("doc_id", (F.col("e") - F.col("s")).alias("width"))


@query("SELECT vec_id, label FROM embeddings WHERE label <= 4")
def flt_03_vector_scope(t: Tables) -> DataFrame:
    """Vectors up to a chapter (inclusive), filtered before any search."""
    return t.embeddings.where("label <= 4").select("vec_id", "label")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') OR contains(text, 'der')")
def flt_04_any_term(t: Tables) -> DataFrame:
    """Documents with one of some terms, case-sensitive."""
    return t.documents.where(scope.contains_any(F.col("text"), ["the", "der"])).select("doc_id")


#: A line that opens a worked example or a solution, as DuckDB reads it.
EXAMPLE_SQL = r"(?i)(?:^|[\n\r\f])[ \t\v]*(?:solution(?:[^\pL\pN_]*[\s]|[^\pL\pN_]*$)|example[^\pL\pN_\n\r\f]*[ \t\v]+[0-9])"


@query(rf"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '{EXAMPLE_SQL}') AND regexp_matches(lower(regexp_replace(text, '\s+', ' ', 'g')), '{scope.RULE_CUE}')")
def flt_05_rule_cue(t: Tables) -> DataFrame:
    """Documents that seem to state a rule."""
    return t.documents.where(scope.states_rule(F.col("text"))).select("doc_id")


@query(rf"SELECT page_id AS id, regexp_matches(html, '{EXAMPLE_SQL}') AS is_example FROM pages")
def flt_06_worked_example(t: Tables) -> DataFrame:
    """Whether a page has a line that opens an example or solution."""
    return t.pages.select(F.col("page_id").alias("id"), scope.is_worked_example(F.col("html")).alias("is_example"))


@query(rf"SELECT doc_id, 'FORMULA_REVIEW_REQUIRED' AS status FROM documents WHERE contains(text, '=') AND NOT regexp_matches(text, '{EXAMPLE_SQL}') AND NOT regexp_matches(text, '\?\s*$')")
def flt_07_formula_candidates(t: Tables) -> DataFrame:
    """Texts with an equation that are neither example nor question."""
    text = F.col("text")
    return t.documents.where(text.contains("=") & ~scope.is_worked_example(text) & ~text.rlike(r"\?\s*$")).select("doc_id", F.lit("FORMULA_REVIEW_REQUIRED").alias("status"))


@query("SELECT c.conv_id, t.turn AS target_turn, count(*) AS n FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) t ON c.conv_id = t.conv_id AND c.turn != t.turn GROUP BY ALL")
def flt_08_other_chunks(t: Tables) -> DataFrame:
    """How many chunks of the same source aren't the target itself."""
    target = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("target_turn"))
    return t.conversations.join(target, "conv_id").where("turn != target_turn").groupBy("conv_id", "target_turn").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT conv_id, floor(max(turn) / 2)::BIGINT AS p FROM conversations GROUP BY 1)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c.turn >= t.p THEN 'target_or_later_material' END AS reason FROM conversations c JOIN t USING (conv_id)) GROUP BY reason""")
def flt_09_violations(t: Tables) -> DataFrame:
    """Records by why they may not be cited for a target in the middle of their source."""
    target = t.conversations.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("p")).withColumnRenamed("conv_id", "source")
    joined = t.conversations.join(target, F.col("conv_id") == F.col("source"))
    return joined.groupBy(scope.violation(F.col("conv_id"), F.col("turn"), F.col("source"), F.col("p")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, substr(text, 11, 20) = substr(reverse(substr(reverse(text), 1, len(text) - 10)), 1, 20) AS same FROM documents WHERE len(text) > 30")
def flt_10_original_record(t: Tables) -> DataFrame:
    """Whether a stored excerpt equals the source text between its offsets."""
    d = t.documents.where(F.length("text") > 30).select("doc_id", "text", F.substring("text", 11, 20).alias("content"), F.lit(10).alias("start"))
    return d.select("doc_id", (F.expr("substring(text, start + 1, 20)") == F.col("content")).alias("same"))


@query("SELECT page_id FROM pages WHERE contains(html, '&amp;') OR contains(lower(html), '<script')")
def flt_11_pattern_search(t: Tables) -> DataFrame:
    """Pages where either of two forms has a pattern."""
    return t.pages.where(F.col("html").contains("&amp;") | F.lower("html").contains("<script")).select("page_id")


@query("""
WITH q AS (SELECT list_distinct(list_filter(regexp_extract_all(lower('What is the small ring for and why steel'), '[a-z]{3,}'), lambda x: NOT list_contains(['what','the','for','and','why'], x))) AS terms)
SELECT p_partkey, p_name, p_partkey IN (7, 3) AS seed FROM part, q WHERE p_partkey IN (7, 3) OR len(list_filter(terms, lambda x: contains(lower(p_name), x))) > 0""")
def flt_12_concepts(t: Tables) -> DataFrame:
    """Parts that are seeds or have a term of the question in their name."""
    from ..operators.retrieval import question_terms

    terms = question_terms("What is the small ring for and why steel")
    hit = F.col("p_partkey").isin(7, 3)
    return t.part.where(hit | scope.contains_any(F.lower("p_name"), terms)).select("p_partkey", "p_name", hit.alias("seed"))


@query("""
WITH m AS (SELECT conv_id, max(turn) AS p FROM conversations GROUP BY 1), c AS (SELECT conv_id, list_sort(list(turn)) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, len(list_filter(turns, lambda x: x >= p)) = 0 AS admissible FROM c JOIN m USING (conv_id)""")
def flt_13_citations(t: Tables) -> DataFrame:
    """Whether all cited positions lie before the target."""
    c = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("p"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", (F.size(F.array_except("turns", F.filter("turns", lambda x: x < F.col("p")))) == 0).alias("admissible"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'signup')")
def flt_14_by_type(t: Tables) -> DataFrame:
    """Rows of the wanted types."""
    return t.events.where(F.col("event_type").isin("click", "signup")).select("event_id")


@query("""
SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 8000 THEN 'too_long' END, CASE WHEN lang != 'en' THEN 'language' END, CASE WHEN contains(text, '=') THEN 'formula' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def flt_15_exclusion_reasons(t: Tables) -> DataFrame:
    """Every reason for which a document would be left out."""
    tests = {"too_short": F.col("n_chars") < 200, "too_long": F.col("n_chars") > 8000, "language": F.col("lang") != "en", "formula": F.col("text").contains("=")}
    return t.documents.select("doc_id", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items()))).alias("reasons"))


@query(r"SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(regexp_replace(d.text, '\s', '', 'g'), regexp_replace(b.text, '\s', '', 'g'))")
def flt_16_target_coverage(t: Tables) -> DataFrame:
    """Benchmark passages that a document holds, white space aside."""
    from ..operators.retrieval import contained

    strip = lambda c: F.regexp_replace(c, r"\s", "")
    return contained(t.documents.select("doc_id", strip("text").alias("text")), t.benchmark.select("item_id", strip("text").alias("quote"))).select("item_id", "doc_id")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(?:fig(?:ure)?\.?\s*\d|shown (?:in|below|above)|diagram)') THEN 'INPUT_REVIEW_REQUIRED' ELSE 'OK' END AS status FROM documents")
def flt_17_figure_gate(t: Tables) -> DataFrame:
    """Questions that point to a figure go to review."""
    return t.documents.select("doc_id", F.when(F.col("text").rlike(scope.FIGURE_CUE), "INPUT_REVIEW_REQUIRED").otherwise("OK").alias("status"))


@query("SELECT event_id, coalesce(TRY_CAST(props->>'k' AS INT), 999) AS chapter FROM events WHERE coalesce(TRY_CAST(props->>'k' AS INT), 999) <= 10")
def flt_18_clean_chapters(t: Tables) -> DataFrame:
    """Chapters as numbers, 999 if missing; the first ten are kept."""
    chapter = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(999))
    return t.events.select("event_id", chapter.alias("chapter")).where("chapter <= 10")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42 AND c_mktsegment IS NOT NULL")
def flt_19_point_lookup(t: Tables) -> DataFrame:
    """One node by id."""
    return t.customer.where("c_custkey = 42 AND c_mktsegment IS NOT NULL").select("c_custkey", "c_name")


@query("SELECT p_name, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY p_name HAVING len(list_filter(list(DISTINCT p_brand), lambda x: contains(x, '#1'))) > 0")
def flt_20_by_source(t: Tables) -> DataFrame:
    """Concepts of which some source has a pattern in its name."""
    g = t.part.groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    return g.where(F.exists("brands", lambda s: s.contains("#1")))
