"""Definitions, exact expressions, regions of pages, references and staged workflows over the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import algebra
from ..operators import balanced, controls, corpus, definitions, extraction, generation, questions, references, regions
from ..operators.ranges import until
from ..operators.rounds import Rounds
from .registry import Tables, query, spread

#: A line of an order is defined by the two lines after it; an order's claim is its customer's number of units.
NODES_SQL = "SELECT l_orderkey AS c, l_linenumber AS n, sum(l_quantity)::BIGINT AS q, max(l_shipdate) AS at FROM lineitem GROUP BY ALL"


def order_definitions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each order is a case: its lines are definitions that use the next two lines, of which those shipped late may not be seen."""
    lines = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("node")).agg(F.sum("l_quantity").cast("long").alias("offset"), F.max("l_shipdate").alias("at"))
    orders = t.orders.select(F.col("o_orderkey").alias("case"), (F.col("o_custkey") % 9).alias("x"), F.expr("o_orderdate + INTERVAL 2000 DAYS").alias("target"), (F.col("o_totalprice") / 1000).cast("long").alias("claim"), (F.col("o_orderpriority") == "1-URGENT").alias("preview"))
    numbers = lines.groupBy("case").agg(F.min("node").alias("root"), F.collect_set("node").alias("numbers"))  # of seven numbers at most
    next_line = lambda k: F.when(F.array_contains("numbers", F.col("node") + k), F.col("node") + k)
    rules = lines.join(numbers, "case").join(orders.select("case", "target"), "case")
    rules = rules.select("case", "node", next_line(1).alias("left"), next_line(2).alias("right"), "offset", (F.col("at") < F.col("target")).alias("seen"))
    return rules, orders.join(numbers, "case").select("case", "root", "x", "claim", "preview")


@query(f"""
WITH RECURSIVE l AS ({NODES_SQL}),
o AS (SELECT o_orderkey AS c, o_custkey % 9 AS x, o_orderdate + INTERVAL 2000 DAYS AS target, trunc(o_totalprice / 1000)::BIGINT AS claim, o_orderpriority = '1-URGENT' AS preview FROM orders),
r AS (SELECT c, min(n) AS root FROM l GROUP BY c),
walk AS (
  SELECT c, root AS n FROM r
  UNION ALL SELECT w.c, k.n FROM walk w JOIN l k ON k.c = w.c AND (k.n = w.n + 1 OR k.n = w.n + 2)),
steps AS (
  SELECT w.c, w.n, l.q, l.at >= o.target AS late,
    2 - (SELECT count(*) FROM l k WHERE k.c = w.c AND k.n IN (w.n + 1, w.n + 2)) AS leaves
  FROM walk w JOIN l ON l.c = w.c AND l.n = w.n JOIN o ON o.c = w.c),
v AS (SELECT c, bool_or(late) AS gap, sum(q + leaves * x)::BIGINT AS value, list_sort(list_distinct(list(n))) AS needed FROM steps JOIN o USING (c) GROUP BY c)
SELECT c AS "case", CASE WHEN preview THEN 'PASS' WHEN gap THEN 'FAIL_GAP' WHEN value = claim THEN 'PASS' ELSE 'FAIL_LOGIC' END AS verdict,
  CASE WHEN NOT preview AND NOT gap THEN value END AS value, CASE WHEN preview THEN [] ELSE needed END AS needed
FROM v JOIN o USING (c)""")
def rul_19_oracle(t: Tables) -> DataFrame:
    """Orders as systems of definitions, solved from the lines that may be seen."""
    return definitions.verdicts(*order_definitions(t))


NEEDED_SQL = "SELECT p.p_partkey, p.p_size AS s, regexp_extract(p.p_brand, '[0-9]+')::INT AS b, n.p_size AS s2, regexp_extract(n.p_brand, '[0-9]+')::INT AS b2 FROM part p JOIN part n ON n.p_partkey = p.p_partkey // 2"


def parts_with_needed(t: Tables) -> DataFrame:
    """Each part's size and brand number (s, b), and those of the part that it needs (s2, b2)."""
    number = lambda side: F.regexp_extract(F.col(f"{side}.p_brand"), "[0-9]+", 0)
    pairs = t.part.alias("p").join(t.part.alias("n"), F.expr("n.p_partkey = p.p_partkey div 2"))
    return spread(pairs.select("p.p_partkey", F.col("p.p_size").cast("string").alias("s"), number("p").alias("b"), F.col("n.p_size").cast("string").alias("s2"), number("n").alias("b2")))


@query(f"SELECT p_partkey, CASE WHEN b = b2 THEN 'UNDEFINED' WHEN s = s2 THEN 'EQUIVALENT' ELSE 'DIFFERENT' END AS status FROM ({NEEDED_SQL})")
def rul_20_equivalence(t: Tables) -> DataFrame:
    """A square in factors by one part's size and the same written out by another's, both over a difference of brands."""
    p = parts_with_needed(t)
    left = F.format_string("\\frac{(x+%s)^{2}}{%s-%s}", "s", "b", "b2")
    right = F.format_string("(x^2 + 2 \\cdot %s x + %s*%s)/(%s-%s)", "s2", "s2", "s2", "b", "b2")
    forms = p.select("p_partkey", algebra.postfix(algebra.plain(left)).alias("l"), algebra.postfix(algebra.plain(right)).alias("r"))
    return forms.select("p_partkey", algebra.equivalence(F.col("l"), F.col("r")).alias("status"))


@query(f"""
SELECT p_partkey, 'parse' AS answer, b = b2 AS solves, CASE WHEN s2 > 25 THEN [3] ELSE [] END::INT[] AS unreadable,
  list_filter([CASE WHEN s = b2 THEN 0 END, CASE WHEN b2 - s = b - s2 THEN 1 END, CASE WHEN s2 = 2 OR s = b2 THEN 2 END], lambda v: v IS NOT NULL)::INT[] AS equal
FROM ({NEEDED_SQL})""")
def rul_23_answers(t: Tables) -> DataFrame:
    """Questions by one part, answers by the other: whether the answer solves it, which distractors equal it or can't be read."""
    p = parts_with_needed(t)
    broken = F.when(F.col("s2").cast("int") > 25, F.concat("s2", F.lit(" not"), F.lit(" (a number"))).otherwise(F.concat("s2", F.lit("*y")))
    distractors = F.array(F.format_string("%s-%s", "s", "b2"), F.format_string("%s - %s", "b", "s2"), F.format_string("(%s*%s - %s*%s)/2", "s2", "b2", "s2", "s"), broken)
    found = algebra.verify_answer(F.format_string("x + %s = %s", "s", "b"), F.format_string("%s - %s", "b2", "s"), distractors)
    return p.select("p_partkey", found.alias("f")).select("p_partkey", "f.*")


@query(f"""
SELECT p_partkey, i, CASE i WHEN 0 THEN 'parse' WHEN 1 THEN CASE WHEN s = b THEN 'parse' ELSE 'soft' END ELSE CASE WHEN s > b THEN 'invalid' ELSE 'parse' END END AS tier
FROM ({NEEDED_SQL}), (VALUES (0), (1), (2)) v(i)""")
def rul_32_two_tiers(t: Tables) -> DataFrame:
    """Formulas that can be read, that only look like formulas, and that do neither."""
    p = parts_with_needed(t)
    s, b = F.col("s").cast("int"), F.col("b").cast("int")
    texts = F.array(F.format_string("$\\left(\\dfrac{%s}{%s} \\times x\\right)^2$", "s", "b"), F.when(s == b, F.lit("xy z")).otherwise(F.format_string("x_{%s} \\leq %s", "s", "b")), F.when(s > b, F.format_string("(%s", "s")).otherwise(F.format_string("(%s)", "s")))
    return p.select("p_partkey", F.posexplode(texts).alias("i", "text")).select("p_partkey", "i", algebra.verify_parse(F.col("text")).alias("tier"))


@query("""
SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'unsupported_expression_syntax' WHEN p_size + 1 > 48 THEN 'expression_depth_bound'
  WHEN (p_retailprice * 1000000000)::BIGINT > 1000000000000 THEN 'integer_bound' ELSE 'ok' END AS status FROM part""")
def scf_39_bounded(t: Tables) -> DataFrame:
    """Calls within calls, as many as a part's size, of a sum with its price, some of them with a name that isn't known."""
    price = (F.col("p_retailprice") * 1000000000).cast("long").cast("string")
    inner = F.concat(F.when(F.col("p_name").contains("ring"), "y").otherwise("x"), F.lit(" + "), price)
    return spread(t.part).select("p_partkey", algebra.bounded(F.concat(F.repeat(F.lit("f("), F.col("p_size")), inner, F.repeat(F.lit(")"), F.col("p_size")))).alias("status"))


#: Texts whose commas and full stops are read as brackets, so that there are nested, crossed and open ones.
BRACKETED = ",.", "()"


@query(rf"""
WITH d AS (SELECT doc_id, translate(text, '{BRACKETED[0]}', '{BRACKETED[1]}') AS t FROM documents),
p AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '[()]'), lambda x: x) AS pieces, regexp_extract_all(t, '[()]') AS marks FROM d WHERE contains(t, '(')),
r AS (SELECT doc_id, i, pieces[i] AS piece, marks[i] = '(' AS opens FROM (SELECT doc_id, pieces, marks, unnest(range(1, len(marks) + 1)) AS i FROM p)),
w AS (SELECT doc_id, i, opens, regexp_extract(piece, '(?:^|[^\pL\pM\pN_])((?:sqrt|root|ln|log|sin|cos|tan|exp|[A-Za-z])\s*)$', 1) AS named,
  (sum(len(piece)) OVER o + i - 1)::BIGINT AS pos, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER o AS depth
  FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, depth - CASE WHEN opens THEN 1 ELSE 0 END ORDER BY i) AS close FROM w)
SELECT doc_id, pos - len(named) AS "start", close + 1 AS "end", regexp_extract(named, '^[A-Za-z]+') AS name, (depth - 1)::BIGINT AS level
FROM m WHERE opens AND named != '' AND close IS NOT NULL""")
def scf_26_balanced_calls(t: Tables) -> DataFrame:
    """Offsets of every balanced call in every text, its commas and full stops taken for brackets."""
    return balanced.calls(t.documents.select("doc_id", F.translate("text", *BRACKETED).alias("t")), "doc_id", "t")


#: Characters of sources that a task makes spans of, on average.
SOURCE = 1 << 21
#: Columns and points of a page that is set from the words of its source.
WIDTH, POINTS, LINE, HEIGHT = 100, 4.0, 12.0, 10.0
TOKEN = r"[A-Za-z]+=?|[0-9]+|[^A-Za-z0-9\s]"
#: SQL's \s (Java's has the vertical tab besides), and a piece with the one space after it.
SPACE, PIECE = r"[\t\n\f\r ]", "(?:[A-Za-z]+=?|[0-9]+|[^A-Za-z0-9 ]) ?"
SPANS_SQL = rf"""
word AS (SELECT page_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT page_id, regexp_split_to_array(translate(html, '.', '='), '\s+') AS w FROM pages)),
token AS (SELECT page_id, i, unnest(k) AS text, generate_subscripts(k, 1) AS j, len(k) AS many FROM (SELECT page_id, i, regexp_extract_all(word, '{TOKEN}') AS k FROM word)),
spot AS (SELECT page_id AS page, text, row_number() OVER o - 1 AS n, (sum(len(text) + (j = many)::INT) OVER o - len(text) - (j = many)::INT)::BIGINT AS pos FROM token WINDOW o AS (PARTITION BY page_id ORDER BY i, j ROWS UNBOUNDED PRECEDING)),
s AS (SELECT page, n, text, {POINTS} * (pos % {WIDTH}) AS x0, {LINE} * (pos // {WIDTH}) AS y0, {POINTS} * (pos % {WIDTH} + len(text)) AS x1, {LINE} * (pos // {WIDTH}) + {HEIGHT} AS y1, regexp_full_match(trim(text), '[{regions.SIGNS}]+') AND NOT regexp_matches(text, '[A-Za-z]{{4}}') AND len(text) <= {regions.LONGEST} AS math FROM spot)"""


def page_spans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages set in lines of WIDTH columns from the pieces of their source, whose full stops are read as equals signs.

    Sources are dealt by page before they become spans, as they are far smaller, to so many
    tasks that each has SOURCE characters on average.
    """
    chars = t.pages.agg(F.sum(F.length("html"))).first()[0] or 0
    dealt = t.pages.select(F.col("page_id").alias("page"), "html").repartition(max(t.spark.sparkContext.defaultParallelism, -(-chars // SOURCE)), "page")
    # words one space apart: each piece with the space after it, so that lengths add up to columns
    source = F.trim(F.regexp_replace(F.translate("html", ".", "="), f"{SPACE}+", " "))
    pieces = dealt.select("page", F.posexplode(F.regexp_extract_all(source, F.lit(PIECE), F.lit(0))).alias("n", "piece"))
    line = Window.partitionBy("page").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("piece")
    spot = pieces.select("page", "n", F.rtrim("piece").alias("text"), (F.sum(size).over(line) - size).alias("at"))
    row = F.floor(F.col("at") / WIDTH)
    spans = spot.select("page", "n", "text", (POINTS * (F.col("at") % WIDTH)).alias("left"), (LINE * row).alias("top"), (POINTS * F.length("text")).alias("width"), F.lit(HEIGHT).alias("height"))
    pages = t.pages.select(F.col("page_id").alias("page"), F.lit(POINTS * WIDTH).alias("page_width"), (LINE * (F.floor(F.length("html") * 2 / WIDTH) + 2)).alias("page_height"))
    return spans, pages


REGIONS_SQL = f"""
WITH RECURSIVE {SPANS_SQL},
near AS (
  SELECT a.page, a.n, greatest(0, min(b.x0) - 1) AS x0, greatest(0, min(b.y0) - 1) AS y0, least({POINTS * WIDTH}, max(b.x1) + 1) AS x1, max(b.y1) + 1 AS y1
  FROM s a JOIN s b ON a.page = b.page AND (b.math OR a.n = b.n) AND b.x0 <= a.x1 + 28 AND b.x1 >= a.x0 - 28 AND b.y0 <= a.y1 + 9 AND b.y1 >= a.y0 - 9
  WHERE contains(a.text, '=') AND a.math GROUP BY a.page, a.n),
grow AS (
  SELECT * FROM near
  UNION
  SELECT g.page, g.n, least(any_value(g.x0), min(s.x0)), g.y0, greatest(any_value(g.x1), max(s.x1)), g.y1
  FROM grow g JOIN s ON s.page = g.page AND s.y0 >= g.y0 AND s.y1 <= g.y1 AND s.x0 <= g.x1 + 3 AND s.x1 >= g.x0 - 3
  GROUP BY g.page, g.n, g.x0, g.y0, g.x1, g.y1),
box AS (SELECT page, n, min(x0) AS x0, y0, max(x1) AS x1, y1 FROM grow GROUP BY page, n, y0, y1),
held AS (SELECT b.page, b.n, list(DISTINCT [s.x0::VARCHAR, s.y0::VARCHAR, s.text] ORDER BY [s.x0::VARCHAR, s.y0::VARCHAR, s.text]) AS signs
  FROM box b JOIN s ON s.page = b.page AND s.x0 >= b.x0 AND s.x1 <= b.x1 AND s.y0 >= b.y0 AND s.y1 <= b.y1 GROUP BY b.page, b.n),
kept AS (SELECT page, min(n) AS n FROM held GROUP BY page, signs),
region AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY n) - 1 AS region, n, x0, y0, x1, y1 FROM kept JOIN box USING (page, n))"""


@query(f"{REGIONS_SQL} SELECT page, region, n, x0, y0, x1, y1 FROM region")
def src_12_regions(t: Tables) -> DataFrame:
    """Regions of all pages around equals signs."""
    return regions.equation_regions(*page_spans(t), dealt=True)


#: What heads a part of a page.
HEAD = "^(?:article|footer|nav)$"


@query(f"""{REGIONS_SQL},
head AS (SELECT page, n, y0, text FROM s WHERE regexp_matches(text, '{HEAD}')),
above AS (
  SELECT r.page, r.region, s.n AS sn FROM region r JOIN s ON s.page = r.page AND s.y0 >= r.y0 - 45 AND s.y1 <= r.y0 AND s.x0 < r.x1 + 250 AND s.x1 > r.x0 - 30
  UNION
  SELECT a.page, a.region, v.n FROM above a JOIN region r USING (page, region) JOIN s u ON u.page = a.page AND u.n = a.sn
  JOIN s v ON v.page = a.page AND abs(v.y0 - u.y0) <= 3 AND v.x0 - u.x1 BETWEEN -3 AND 3 AND v.y1 <= r.y0)
SELECT r.page, r.region,
  CASE WHEN r.y1 >= (SELECT min(y0) FROM head h WHERE h.page = r.page) THEN 'example_or_later' ELSE 'unclassified_source' END AS role,
  coalesce((SELECT list_sort(list_distinct(list(s.text[1]))) FROM s WHERE s.page = r.page AND s.x0 >= r.x0 AND s.x1 <= r.x1 AND s.y0 >= r.y0 AND s.y1 <= r.y1 AND regexp_full_match(s.text, '[A-Za-z]=?')), []) AS letters,
  (SELECT max_by(text, y0 * 1000000 + n) FROM head h WHERE h.page = r.page AND h.y0 <= r.y0) AS heading,
  (SELECT coalesce(string_agg(s.text, ' ' ORDER BY s.y0, s.x0, s.n), '') FROM above a JOIN s ON s.page = a.page AND s.n = a.sn WHERE a.page = r.page AND a.region = r.region) AS preceding
FROM region r""")
def src_13_candidates(t: Tables) -> DataFrame:
    """Role, letters, heading and preceding text of every region (single letters of its spans)."""
    spans, pages = page_spans(t)
    lines = regions.page_lines(spans, dealt=True)
    n = regions.tasks(lines)
    return regions.candidates_of(lines, regions.regions_of(lines, pages, n), HEAD, n).withColumnRenamed("symbols", "letters")


REFERS = r"passage d(\d+)"


@query("""
WITH RECURSIVE p AS (SELECT l_orderkey AS c, l_linenumber AS d, max(l_extendedprice) AS price, list_sort(list_distinct(list([l_suppkey % 9, l_partkey % 9]))) AS refs FROM lineitem GROUP BY ALL),
r AS (SELECT c, list(d ORDER BY price DESC, d) AS ranking FROM p GROUP BY c),
walk AS (
  SELECT c, ranking[1:2] AS ids, 1 AS pos FROM r
  UNION ALL
  SELECT w.c, list_concat(w.ids, coalesce((SELECT list(v ORDER BY nth) FROM (
    SELECT v, min(nth) AS nth FROM (SELECT unnest(flatten(refs)) AS v, generate_subscripts(flatten(refs), 1) AS nth FROM p WHERE p.c = w.c AND p.d = w.ids[w.pos])
    WHERE NOT list_contains(w.ids, v) AND v IN (SELECT d FROM p WHERE p.c = w.c) GROUP BY v)), [])[1:4 - len(w.ids)]), w.pos + 1
  FROM walk w WHERE w.pos <= len(w.ids)),
ended AS (SELECT c, max_by(ids, pos) AS ids FROM walk GROUP BY c),
full_list AS (SELECT c, ids, list_concat(ids, list_filter(ranking, lambda v: NOT list_contains(ids, v))[1:4 - len(ids)]) AS every FROM ended JOIN r USING (c))
SELECT c AS "case", (i - 1)::INT AS place, every[i] AS id, CASE WHEN i <= 2 THEN 'ranked' WHEN i <= len(ids) THEN 'referred' ELSE 'filled' END AS how
FROM (SELECT c, ids, every, unnest(range(1, len(every) + 1)) AS i FROM full_list)""")
def joi_06_follow_references(t: Tables) -> DataFrame:
    """The two dearest lines of each order, the lines that they refer to, and more by price."""
    pairs = F.array_sort(F.collect_set(F.array(F.col("l_suppkey") % 9, F.col("l_partkey") % 9)))
    lines = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("id")).agg(F.max("l_extendedprice").alias("price"), pairs.alias("refs"))
    text = F.array_join(F.transform(F.flatten("refs"), lambda v: F.concat(F.lit("see passage d"), v.cast("string"))), ", ")
    passages = lines.select("case", F.col("id").cast("string").alias("id"), text.alias("text"))
    ranking = lines.select("case", F.col("id").cast("string").alias("id"), F.struct((-F.col("price")).alias("p"), "id").alias("rank"))
    return references.follow(passages, ranking, REFERS).withColumn("id", F.col("id").cast("int"))


LINES_SQL = "SELECT l_orderkey AS o, l_linenumber AS n, max(l_extendedprice) AS price, max_by(l_quantity, l_extendedprice)::INT AS q, round(max_by(l_discount, l_extendedprice) * 100)::INT AS d, round(max_by(l_tax, l_extendedprice) * 100)::INT AS x, max_by(l_returnflag, l_extendedprice) AS flag, max_by(l_linestatus, l_extendedprice) AS status, max_by(l_suppkey, l_extendedprice) AS supp FROM lineitem GROUP BY ALL"


def order_lines(t: Tables) -> DataFrame:
    """The dearest line of each number of an order: o, n, quantity q, discount d and tax x in percent, flag, status and supplier."""
    top = F.max_by(F.struct("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_suppkey"), "l_extendedprice")
    # by order from the first: its lines are told apart and gathered where they lie
    rows = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(top.alias("r"))
    percent = lambda c: F.round(F.col(c) * 100).cast("int")
    return rows.select("o", "n", F.col("r.l_quantity").cast("int").alias("q"), percent("r.l_discount").alias("d"), percent("r.l_tax").alias("x"), F.col("r.l_returnflag").alias("flag"), F.col("r.l_linestatus").alias("status"), F.col("r.l_suppkey").alias("supp"))


@query(f"""
WITH l AS ({LINES_SQL}), last AS (SELECT * FROM l QUALIFY n = max(n) OVER (PARTITION BY o)),
c AS (SELECT a.o, list(b.n ORDER BY b.n DESC)[1:4] AS context FROM last a JOIN l b ON a.o = b.o AND b.n < a.n GROUP BY a.o),
s AS (SELECT last.*, context, (supp % 7 + 1)::INT AS cites, (SELECT status FROM l k WHERE k.o = last.o AND k.n = last.supp % 7 + 1) AS cited_status FROM last LEFT JOIN c USING (o)),
g AS (SELECT o, CASE WHEN d > 9 THEN 'figure' WHEN context IS NULL THEN 'no_evidence' WHEN flag = 'N' AND status = 'O' THEN 'no_judgment' WHEN NOT list_contains(context, cites) THEN 'citation'
  WHEN flag = 'R' AND x > 6 THEN 'conflicting_answer' WHEN flag = 'R' THEN 'verdict' WHEN flag = 'A' AND q > 45 THEN 'no_citation' WHEN x = 0 THEN 'no_answer' WHEN q * d != q * x THEN 'calculation'
  WHEN cited_status != 'F' THEN 'work' ELSE 'none' END AS guard FROM s)
SELECT guard, CASE guard WHEN 'figure' THEN 'INPUT_REVIEW_REQUIRED' WHEN 'no_evidence' THEN 'ERROR' WHEN 'no_judgment' THEN 'ERROR' WHEN 'citation' THEN 'ERROR' WHEN 'conflicting_answer' THEN 'ERROR'
  WHEN 'verdict' THEN 'FAIL_GAP' WHEN 'no_citation' THEN 'ABSTAIN' WHEN 'no_answer' THEN 'ABSTAIN' WHEN 'calculation' THEN 'REJECTED_CALCULATION' WHEN 'work' THEN 'QUANTITY_REVIEW_REQUIRED' ELSE 'ARITHMETIC_CHECKED' END AS status, o AS id FROM g""")
def pip_03_question_audit(t: Tables) -> DataFrame:
    """The last line of each order asked as a question; the lines before it are what it may cite."""
    lines = Rounds(t.spark, "lines").keep("lines", order_lines(t))
    passages = lines.select(F.col("o").alias("source"), F.col("n").alias("position"), F.col("n").cast("string").alias("id"), F.when(F.col("status") == "F", "We read:\nW = V Q").otherwise("Nothing is said.").alias("text"))
    last = lines.groupBy("o").agg(F.max("n").alias("n")).join(lines, ["o", "n"])
    drawn = F.when(F.col("d") > 9, " The circuit is shown below.").otherwise("")
    text = F.concat(F.lit("How much work moves a charge of "), F.col("q").cast("string"), F.lit(" C across a potential difference of "), F.col("d").cast("string"), F.lit(" V?"), drawn)
    asked = last.select(F.col("o").alias("id"), text.alias("question"), F.lit("").alias("background"), F.col("o").alias("source"), F.col("n").alias("before"), F.lit(None).cast("string").alias("region"))
    fails, answered = F.col("flag") == "R", (F.col("flag") != "R") | (F.col("x") > 6)
    none = F.array().cast("array<string>")
    judged = last.where("NOT (flag = 'N' AND status = 'O')").select(
        F.col("o").alias("id"),
        F.when(fails, "FAIL_GAP").otherwise("PASS").alias("verdict"),
        F.array((F.col("supp") % 7 + 1).cast("string")).alias("cited"),
        F.when((F.col("flag") == "A") & (F.col("q") > 45), F.array(F.lit("a rule"))).otherwise(none).alias("missing"),
        F.when(answered, F.concat_ws("*", F.col("q").cast("string"), F.col("d").cast("string"))).alias("expression"),
        F.when(answered, (F.col("q") * F.col("x")).cast("string")).alias("claimed"),
        F.when(answered & (F.col("x") > 0), "J").alias("unit"),
        none.alias("statements"),
    )
    return questions.audit_questions(asked, passages, judged).select("id", "status", "guard")


def write_item(request: dict) -> str | None:
    """A stand-in for a model: a question by the numbers of its topic, whose options get better with each attempt and with what was said of the last one."""
    s, b, s2, b2 = (int(v) for v in request["topic"].split(":")[1].split("/"))
    attempt, feedback = request["attempt"], request["feedback"]
    if s == s2 and attempt == 1:
        return None
    answer = f"{b} - {s}" if b > 5 or attempt > 1 else f"({b} - {s}"
    wrong = {"B": f"{b2} - {s2}", "C": f"{s} - {b}" if "Distractor" not in feedback else "0 - 1000", "D": f"2*({b} - {s})" if "Distractor" not in feedback else "1000"}
    steps = ["Subtract."] if s2 < 40 or "steps" in feedback else []
    return json.dumps({"question": f"Solve x + {s} = {b}", "question_latex": f"x + {s} = {b}", "options": {"A": answer, **wrong}, "correct_answer": "A", "solution_steps": steps})


@query(f"""
WITH x AS (SELECT p_partkey, s, b, s2, b2, s = s2 AS none1, b2 - s2 = b - s AS same, s = b AS zero FROM ({NEEDED_SQL})),
one AS (SELECT *, NOT none1 AND b <= 5 AS broken1, NOT none1 AND b > 5 AND (same OR zero) AS equal1, NOT none1 AND s2 >= 40 AS steps1 FROM x),
two AS (SELECT *, none1 OR broken1 OR equal1 OR steps1 AS fail1 FROM one),
three AS (SELECT *, fail1 AND (same OR (zero AND NOT equal1)) AS equal2, fail1 AND s2 >= 40 AND NOT steps1 AS steps2 FROM two),
four AS (SELECT *, equal2 OR steps2 AS fail2 FROM three),
five AS (SELECT *, fail2 AND (same OR (zero AND NOT equal2)) AS equal3, fail2 AND s2 >= 40 AND NOT steps2 AS steps3 FROM four)
SELECT p_partkey, NOT (equal3 OR steps3) AS verified, CASE WHEN NOT fail1 THEN 1 WHEN NOT fail2 THEN 2 ELSE 3 END AS attempts, CASE WHEN equal3 OR steps3 THEN 0.2 ELSE 1 END AS confidence FROM five""")
def str_10_generate_and_verify(t: Tables) -> DataFrame:
    """Questions by pairs of parts, generated by a stand-in, verified, and corrected by what was wrong."""
    topics = parts_with_needed(t).select(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), F.concat_ws("/", "s", "b", "s2", "b2")).alias("topic"), F.lit("medium").alias("difficulty"))
    made = generation.generate(topics, write_item)
    return made.select(F.split("topic", ":")[0].cast("long").alias("p_partkey"), "verified", "attempts", F.round("confidence", 6).alias("confidence"))


@query(f"""
SELECT p_partkey, list_filter([CASE WHEN b <= 5 THEN 'Correct answer parse error' END, CASE WHEN b > 5 AND s2 - b2 = s - b THEN 'Distractor 1 is equivalent to correct answer' END,
  CASE WHEN b > 5 AND s = b THEN 'Distractor 2 is equivalent to correct answer' END, CASE WHEN s2 >= 40 THEN 'Missing solution steps' END], lambda v: v IS NOT NULL) AS errors
FROM ({NEEDED_SQL})""")
def str_11_errors(t: Tables) -> DataFrame:
    """What is wrong with questions written from pairs of parts."""
    p = parts_with_needed(t)
    answer = F.when(F.col("b").cast("int") <= 5, F.format_string("(%s - %s", "b", "s")).otherwise(F.format_string("%s - %s", "b", "s"))
    options = F.create_map(F.lit("A"), answer, F.lit("B"), F.format_string("%s - %s", "b2", "s2"), F.lit("C"), F.format_string("%s - %s", "s", "b"))
    steps = F.when(F.col("s2").cast("int") < 40, F.array(F.lit("Subtract."))).otherwise(F.array().cast("array<string>"))
    item = F.struct(F.lit("q").alias("question"), F.format_string("x + %s = %s", "s", "b").alias("question_latex"), options.alias("options"), F.lit("A").alias("correct_answer"), steps.alias("solution_steps"))
    return p.select("p_partkey", generation.errors_of(item).alias("errors"))


TRIPLES_SQL = "SELECT p.p_partkey, p.p_name AS a, n.p_name AS b, c.p_name AS c, p.p_type AS kind, p.p_size AS s, c.p_size AS s3 FROM part p JOIN part n ON n.p_partkey = p.p_partkey // 2 JOIN part c ON c.p_partkey = p.p_partkey // 3"


def part_sources(t: Tables) -> DataFrame:
    """Parts as sources that name the part they need (b), and the part at a third of their key (c), which a claim takes for it."""
    three = t.part.alias("p").join(t.part.alias("n"), F.expr("n.p_partkey = p.p_partkey div 2")).join(t.part.alias("c"), F.expr("c.p_partkey = p.p_partkey div 3"))
    rows = three.select("p.p_partkey", F.col("p.p_name").alias("a"), F.col("n.p_name").alias("b"), F.col("c.p_name").alias("c"), F.col("p.p_type").alias("kind"), F.col("p.p_size").alias("s"), F.col("c.p_size").alias("s3"))
    text = F.concat(F.lit("Parts. "), F.lit("The "), "a", F.lit("\n controls  the "), "b", F.lit(". A "), "a", F.lit(" means a part of "), "kind", F.lit("."))
    return rows.withColumn("text", text)


@query(f"""
SELECT p_partkey AS source, CASE WHEN c != b THEN 'no_directional_witness' WHEN s <= s3 THEN 'review' END AS reason,
  CASE WHEN c = b THEN 7 END::BIGINT AS quote_start, CASE WHEN c = b THEN len('Parts. The ' || a || E'\n controls  the ' || b) END::BIGINT AS quote_end,
  CASE WHEN c = b THEN 'The ' || a || E'\n controls  the ' || b END AS quote
FROM ({TRIPLES_SQL})""")
def pip_05_staged_extraction(t: Tables) -> DataFrame:
    """Claims that one part controls another, against the part's own text: accepted with the place that says so, or rejected with a reason."""
    sources = part_sources(t)
    units = Rounds(t.spark, "units").keep("units", corpus.evidence_units(sources, "p_partkey", "text").withColumnRenamed("p_partkey", "source"))
    key = F.col("p_partkey").alias("source")
    entity = lambda claim, name, role, unit: F.struct(F.lit(claim).alias("claim"), F.col(name).alias("name"), F.lit(role).alias("role"), F.lit(unit).alias("unit"), F.lit(False).alias("layout_verified"))
    entities = sources.select(key, F.explode(F.array(entity("entity_0", "a", "definition", 2), entity("entity_1", "b", "other", 1))).alias("e")).select("source", "e.*")
    relations = sources.select(key, F.lit("edge_0").alias("claim"), F.lit("CONTROLS").alias("kind"), F.col("a").alias("from_name"), F.col("c").alias("to_name"), F.lit(1).alias("unit"))
    said = lambda claim, verdict: F.struct(F.lit(claim).alias("claim"), verdict.alias("verdict"))
    fine = F.lit("SUPPORTED")
    reviews = sources.select(key, F.explode(F.array(said("entity_0", fine), said("entity_1", fine), said("edge_0", F.when(F.col("s") > F.col("s3"), fine).otherwise(F.lit("UNCERTAIN"))))).alias("r")).select("source", "r.*")
    judged = extraction.judge_entities(units, entities, reviews)
    return extraction.judge_relations(units, relations, reviews, judged).select("source", "reason", "quote_start", "quote_end", "quote")


@query("SELECT event_id, event_type, round(value * 2, 4) AS doubled FROM events")
def snk_08_resumable_sink(t: Tables) -> DataFrame:
    """Events through a sink that is run, run again, and run again without its checkpoint: each of them is there once."""
    from ..operators.rounds import shared_folder
    from ..streaming.commits import committed, process_once

    folder = shared_folder(t.spark, "events")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/events.parque[t]")
    work = lambda rows: rows.select("event_id", "event_type", F.round(F.col("value") * 2, 4).alias("doubled"))
    for checkpoint in ("one", "one", "two"):
        process_once(stream, "event_id", f"{folder}/out", f"{folder}/{checkpoint}", work).awaitTermination()
    return committed(t.spark, f"{folder}/out").select("event_id", "event_type", "doubled")


WORDS_SQL = "string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')"


@query(f"""
WITH b AS (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS t, {WORDS_SQL} AS w FROM benchmark),
i AS (SELECT item_id, t, w[1] AS sym, w[-1] AS unit, string_split(t, '.')[1] || '.' AS rule FROM b),
c AS (
  SELECT item_id, 'clean' AS operator, t AS question, t AS source, 'answer' AS expected FROM i
  UNION ALL SELECT item_id, 'missing_rule', t, CASE WHEN contains(t, rule) THEN substr(t, len(rule) + 1) ELSE t END, 'withhold' FROM i
  UNION ALL SELECT item_id, 'damaged_symbol', t, '[unreadable symbol]' || substr(t, len(sym) + 1), 'withhold' FROM i
  UNION ALL SELECT item_id, 'wrong_unit', substr(t, 1, instr(t, unit) - 1) || 'kg' || substr(t, instr(t, unit) + len(unit)), t, 'withhold' FROM i)
SELECT item_id || '_' || operator AS id, md5(question) AS question, md5(source) AS source, 1::BIGINT AS aliases FROM c""")
def rul_27_blinded_controls(t: Tables) -> DataFrame:
    """Passages spoilt in four ways, found again in the blinded packet by its key."""
    text = F.regexp_replace("text", r"\s+", " ")
    words = F.split(text, " ")
    items = t.benchmark.select(F.col("item_id").alias("item"), text.alias("question"), text.alias("source"), F.concat(F.split(text, r"\.")[0], F.lit(".")).alias("rule"), words[0].alias("symbol"), F.element_at(words, -1).alias("unit"), F.lit("kg").alias("other_unit"))
    packet, key = controls.blinded(controls.corruption_cases(items), "review")
    found = key.join(packet, "alias")
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return found.groupBy("id", digest("question").alias("question"), digest("source").alias("source")).agg(F.count_distinct("alias").alias("aliases"))


#: Relations that are wanted before the search stops.
TARGET = 150


@query(f"""
WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice / 500000 >= 0.5) AS n FROM orders GROUP BY 1),
r AS (SELECT o_custkey, n, sum(n) OVER (ORDER BY o_custkey) - n AS before FROM c)
SELECT o_custkey, n AS created FROM r WHERE before < {TARGET}""")
def pip_12_stop_target(t: Tables) -> DataFrame:
    """Concepts in order, with the confident relations of each, up to the one that reaches the target."""
    confident = F.count_if(F.col("o_totalprice") / 500000 >= 0.5)
    concepts = t.orders.groupBy("o_custkey").agg(confident.alias("created"))
    return until(concepts, ["o_custkey"], F.col("created"), TARGET)
