"""Further scalar functions, contracts and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex as x
from ..operators import select
from .registry import Tables, query, spread


def formulas(t: Tables) -> DataFrame:
    parts = (F.lit("$\\left( \\dfrac{"), F.col("p_size").cast("string"), F.lit("}{2} \\times  x_{"), F.col("p_partkey").cast("string"), F.lit("} \\right)  \\leq \\sqrt{y}$"))
    return spread(t.part).select("p_partkey", F.concat(*parts).alias("latex"), "p_brand", "p_size")


@query(r"""
SELECT p_partkey, 0 AS i, '( \frac{' || p_size || '}{2} * x_{' || p_partkey || '} ) \leq \sqrt{y}' AS latex, ['collapse_space', 'drop_sizes', 'strip_delimiters', 'unify_fractions', 'unify_operators'] AS applied FROM part
UNION ALL SELECT p_partkey, 1, 'x_{1} + \frac{1}{' || regexp_extract(p_brand, '[0-9]') || '} e^{y} m (' || p_size || ')',
  ['balance', 'brace_fractions', 'brace_subscripts', 'brace_superscripts', 'collapse_space', 'strip_environments', 'unwrap_text'] FROM part""")
def scf_09_latex_normal(t: Tables) -> DataFrame:
    """Normalised formulas and the steps that changed them."""
    second = F.concat(F.lit("\\begin{cases}  x_1 + \\frac1"), F.regexp_extract("p_brand", "[0-9]", 0), F.lit(" e^y \\text{m} ("), F.col("p_size").cast("string"), F.lit("\\end{cases}"))
    each = formulas(t).select("p_partkey", F.posexplode(F.array("latex", second)).alias("i", "latex"))
    return each.select("p_partkey", "i", x.normalize(F.col("latex")).alias("n")).select("p_partkey", "i", "n.latex", "n.applied")


@query(r"SELECT p_partkey, '( ((' || p_size || ')/(2)) * x_{' || p_partkey || '} ) ≤ sqrt(y)' AS plain FROM part")
def scf_17_plain_text(t: Tables) -> DataFrame:
    """Formulas as plain text."""
    normal = x.normalize(F.col("latex"))["latex"]
    return formulas(t).select("p_partkey", x.rewrite(x.rewrite(normal, x.PLAIN), x.PROVER).alias("plain"))


@query("SELECT n_nationkey, 'x ≤ ' || n_nationkey || ' ∀ y ∈ S' AS lean FROM nation")
def scf_18_prover_text(t: Tables) -> DataFrame:
    """Formulas as prover text."""
    return t.nation.select("n_nationkey", x.rewrite(F.concat(F.lit("x \\le "), F.col("n_nationkey").cast("string"), F.lit(" \\forall y \\in S")), x.PROVER).alias("lean"))


@query("SELECT p_partkey, (p_size % 3)::INT AS crossed, 0 AS unopened, (p_partkey % 2)::INT AS unclosed FROM part")
def scf_41_brackets(t: Tables) -> DataFrame:
    """Bracket errors by a stack."""
    text = F.concat(F.repeat(F.lit("(a]"), F.col("p_size") % 3), F.lit("{[()]}"), F.repeat(F.lit("["), (F.col("p_partkey") % 2).cast("int")))
    return t.part.select("p_partkey", x.brackets(text).alias("b")).select("p_partkey", "b.*")


#: A stack as text: what is open at its end, an x for each crossed and a u for each unopened bracket at its front.
STACK = r"""list_reduce(list_prepend('', regexp_extract_all(html, '[\[\](){}]')), lambda a, m: CASE WHEN m IN ('(', '[', '{') THEN a || m WHEN a = '' OR right(a, 1) IN ('x', 'u') THEN 'u' || a
  WHEN right(a, 1) || m IN ('()', '[]', '{}') THEN left(a, -1) ELSE 'x' || left(a, -1) END)"""


@query(f"SELECT page_id, errors::INT AS errors, round(greatest(0.0::DOUBLE, 1 - 0.1::DOUBLE * errors), 6) AS confidence FROM (SELECT page_id, CASE WHEN html IS NOT NULL THEN len({STACK}) END AS errors FROM pages)")
def scf_14_validation(t: Tables) -> DataFrame:
    """Bracket errors of pages and the confidence that they leave."""
    b = t.pages.select("page_id", x.brackets(F.col("html")).alias("b"))
    errors = F.col("b.crossed") + F.col("b.unopened") + F.col("b.unclosed")
    return b.select("page_id", errors.alias("errors"), F.round(x.confidence(errors, F.lit(0)), 6).alias("confidence"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?: ?[-+*/=] ?[0-9]+)+'), lambda v: replace(v, ' ', '')))) AS fragments FROM documents")
def scf_27_algebra_fragments(t: Tables) -> DataFrame:
    """Chains of numbers and operators, without blanks."""
    found = F.regexp_extract_all("text", F.lit("[0-9]+(?: ?[-+*/=] ?[0-9]+)+"), F.lit(0))
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(F.transform(found, lambda v: F.replace(v, F.lit(" "), F.lit(""))))).alias("fragments"))


@query("SELECT n_nationkey, 'theorem ' || n_name || ' : True := by sorry' AS skeleton FROM nation")
def scf_32_skeleton(t: Tables) -> DataFrame:
    """Proofs replaced by placeholders."""
    code = F.concat(F.lit("theorem "), "n_name", F.lit(" : True := by\n  trivial\n  done"))
    return t.nation.select("n_nationkey", F.regexp_replace(code, r"(?s):=\s*by\b.*", ":= by sorry").alias("skeleton"))


@query("SELECT p_partkey, p_name AS name, left(p_type, 5) AS kind, p_size AS chapter FROM part")
def scf_37_projection(t: Tables) -> DataFrame:
    """Properties of a block as a node."""
    block = F.struct(F.col("p_name").alias("name"), F.substring("p_type", 1, 5).alias("kind"), F.col("p_size").alias("chapter"))
    return t.part.select("p_partkey", block.alias("b")).select("p_partkey", "b.*")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[a-z][_^][a-z0-9]{2,}'))::INT AS n FROM documents")
def scf_42_bare_scripts(t: Tables) -> DataFrame:
    """Sub- and superscripts of several letters without braces."""
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[a-z][_^][a-z0-9]{2,}")).alias("n"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(text, '\s*([,.;])\s*', '\1 ', 'g'), '\s+', ' ', 'g'), ' ') AS clean FROM benchmark")
def scf_46_white_space(t: Tables) -> DataFrame:
    """White space around punctuation and elsewhere made uniform."""
    return t.benchmark.select("item_id", F.trim(F.regexp_replace(F.regexp_replace("text", r"\s*([,.;])\s*", "$1 "), r"\s+", " ")).alias("clean"))


@query("SELECT conv_id, turn, CASE WHEN turn >= n THEN 'unknown_evidence' WHEN ends_with(trim(text, ' '), '?') THEN 'question' ELSE 'usable' END AS state FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)")
def scf_02_localised(t: Tables) -> DataFrame:
    """Whether an evidence number exists and its excerpt isn't a question."""
    n = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("turn") >= F.col("n"), "unknown_evidence").when(F.trim("text").endswith("?"), "question").otherwise("usable")
    return t.conversations.join(n, "conv_id").select("conv_id", "turn", state.alias("state"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' AND value IS NOT NULL AND TRY_CAST(props->>'k' AS INT) < 50 THEN 'SUPPORTED' WHEN event_type = 'purchase' THEN 'INVALID_EVIDENCE' ELSE 'UNRESOLVED' END AS decision FROM events""")
def val_07_witness_decision(t: Tables) -> DataFrame:
    """A witness's decision: stated, with evidence that may be cited."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    stated = F.col("event_type") == "purchase"
    decision = F.when(F.col("event_type") == "error", "ERROR").when(stated & F.col("value").isNotNull() & (k < 50), "SUPPORTED").when(stated, "INVALID_EVIDENCE").otherwise("UNRESOLVED")
    return t.events.select("event_id", decision.alias("decision"))


@query("SELECT o_orderkey, (o_orderstatus = 'F') = (o_totalprice IS NOT NULL AND o_totalprice > 0) OR o_orderstatus != 'F' AS holds FROM orders")
def val_09_answer_contract(t: Tables) -> DataFrame:
    """An answer is there exactly if the verdict has one."""
    answered = F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") > 0)
    return t.orders.select("o_orderkey", (((F.col("o_orderstatus") == "F") == answered) | (F.col("o_orderstatus") != "F")).alias("holds"))


@query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount > 0.08 AND l_tax = 0 THEN 'value_without_unit' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'verdict_conflict' END, CASE WHEN l_quantity > 49 THEN 'out_of_bounds' END], lambda v: v IS NOT NULL) AS issues FROM lineitem""")
def val_12_assessment(t: Tables) -> DataFrame:
    """Inconsistencies of an assessment, all that there are."""
    tests = {"value_without_unit": (F.col("l_discount") > 0.08) & (F.col("l_tax") == 0), "verdict_conflict": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "out_of_bounds": F.col("l_quantity") > 49}
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items()))).alias("issues"))


@query("SELECT n_nationkey, CASE WHEN n = 0 THEN 'NO_SOURCE' WHEN low = 0 THEN 'READY' ELSE 'REVIEW' END AS state FROM (SELECT n_nationkey, count(s_suppkey) AS n, count(*) FILTER (WHERE s_acctbal < 0) AS low FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)")
def val_18_source_gate(t: Tables) -> DataFrame:
    """A source may be used only if it was built completely; no fallback."""
    g = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"), F.count_if(F.col("s_acctbal") < 0).alias("low"))
    return g.select("n_nationkey", F.when(F.col("n") == 0, "NO_SOURCE").when(F.col("low") == 0, "READY").otherwise("REVIEW").alias("state"))


@query("SELECT l.doc_id, d.doc_id IS NOT NULL AND contains(d.text, substr(d.text, 5, 12)) AS attached FROM labels l LEFT JOIN documents d USING (doc_id)")
def val_23_attached_quotes(t: Tables) -> DataFrame:
    """Whether a cited id exists and its text holds the quote."""
    quote = F.substring("text", 5, 12)
    return t.labels.join(t.documents, "doc_id", "left").select("doc_id", (F.col("text").isNotNull() & F.contains("text", quote)).alias("attached"))


@query("SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'ACCEPT' ELSE 'ABSTAIN' END AS decision, CASE WHEN toxic = 1 THEN 'source_mismatch' WHEN quality = 0 THEN 'missing_citation' END AS reason FROM labels l")
def rul_05_guard(t: Tables) -> DataFrame:
    """Evidence is accepted, or withheld with the first reason in a fixed order."""
    reason = F.when(F.col("toxic") == 1, "source_mismatch").when(F.col("quality") == 0, "missing_citation")
    return t.labels.select("doc_id", F.when(reason.isNull(), "ACCEPT").otherwise("ABSTAIN").alias("decision"), reason.alias("reason"))


@query("SELECT conv_id, list_sort(list_filter(list_distinct(list(role)), lambda v: v != 'user')) AS missing FROM conversations GROUP BY 1")
def rul_17_operation_grant(t: Tables) -> DataFrame:
    """Skills that a background doesn't grant."""
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.array_except(F.collect_set("role"), F.array(F.lit("user")))).alias("missing"))


@query(r"SELECT doc_id, regexp_extract(text, '(?i)(\d+(?:\.\d+)?)\s*(?:minutes?|min)\b', 1) AS minutes FROM documents WHERE regexp_matches(text, '(?i)\d+(?:\.\d+)?\s*(?:minutes?|min)\b')")
def rul_30_durations(t: Tables) -> DataFrame:
    """Durations that could be turned into seconds."""
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:minutes?|min)(?U)\b"
    return t.documents.where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 1).alias("minutes"))


@query("SELECT event_id, (value * CASE event_type WHEN 'view' THEN 1000 WHEN 'click' THEN 0.001 ELSE 1 END)::DECIMAL(20,6)::DOUBLE AS scaled FROM events")
def rul_31_scaled(t: Tables) -> DataFrame:
    """Values brought to one unit by their prefix, as decimals."""
    factor = F.when(F.col("event_type") == "view", 1000.0).when(F.col("event_type") == "click", 0.001).otherwise(1.0)
    return t.events.select("event_id", F.round(F.col("value") * factor, 6).alias("scaled"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en') WHERE rank <= 2")
def joi_06_first_two(t: Tables) -> DataFrame:
    """The two best of each source, from which references would be followed."""
    return select.top_k(t.documents.where("lang = 'en'").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 2).select("source", "doc_id", "rank")


@query("SELECT doc_id, instr(text, chr(10)) - 1 AS heading_end, substr(text, 1, instr(text, chr(10)) - 1) AS heading FROM documents WHERE instr(text, chr(10)) > 0")
def src_30_heading(t: Tables) -> DataFrame:
    """The heading of a text and where it ends."""
    at = F.instr("text", "\n")
    return t.documents.where(at > 0).select("doc_id", (at - 1).cast("long").alias("heading_end"), F.substring(F.col("text"), F.lit(1), at - 1).alias("heading"))
