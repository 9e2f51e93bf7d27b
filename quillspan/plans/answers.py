"""Contracts of answers, witnesses and reviews, on answers read from the last line of each order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts, generation, studies
from ..operators.rounds import Rounds, shared_folder
from .derivations import LINES_SQL, NEEDED_SQL, order_lines, parts_with_needed
from .registry import Tables, query

SAID_SQL = f"""
l AS ({LINES_SQL}), last AS (SELECT * FROM l QUALIFY n = max(n) OVER (PARTITION BY o)),
c AS (SELECT a.o, list(b.n::VARCHAR) AS shown, list(b.d < 9) AS readable, list(CASE WHEN b.flag = 'R' AND b.d > 8 THEN 'ERROR' WHEN b.status = 'F' THEN 'SUPPORTED' ELSE 'UNRESOLVED' END) AS requirements,
  list(b.n::VARCHAR) FILTER (WHERE b.d < 9) AS read, list(b.status = 'F') AS judgments FROM last a JOIN l b ON a.o = b.o AND b.n < a.n GROUP BY a.o),
s AS (SELECT last.*, coalesce(shown, []) AS shown, requirements, coalesce(read, []) AS read, coalesce(judgments, []) AS judgments, supp % 7 + 1 AS cites,
  CASE flag WHEN 'N' THEN 'PASS' WHEN 'R' THEN 'FAIL_GAP' ELSE 'ABSTAIN' END AS said, x > 2 AS has_value, x > 4 AS has_unit, d > 0 AS has_cites FROM last LEFT JOIN c USING (o))"""


def said(t: Tables) -> DataFrame:
    """What each order's last line says, and the lines before it, which are what was shown."""
    lines = order_lines(t).where("n IS NOT NULL")
    requirement = F.when((F.col("flag") == "R") & (F.col("d") > 8), "ERROR").when(F.col("status") == "F", "SUPPORTED").otherwise("UNRESOLVED")
    own = F.struct(F.col("n").cast("string").alias("id"), "d", (F.col("status") == "F").alias("holds"), requirement.alias("requirement"))
    orders = lines.groupBy("o").agg(F.max_by(F.struct(*(c for c in lines.columns if c != "o")), "n").alias("last"), F.collect_list(own).alias("every"))  # of seven lines at most
    joined = orders.select("o", "last.*", F.array_sort(F.filter("every", lambda b: b["id"] != F.col("last.n").cast("string"))).alias("before"))
    status = F.when(F.col("flag") == "N", "PASS").when(F.col("flag") == "R", "FAIL_GAP").otherwise("ABSTAIN")
    cites = F.when(F.col("d") > 0, F.array((F.col("supp") % 7 + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumns({"said": status, "value": F.when(F.col("x") > 2, F.col("q")), "unit": F.when(F.col("x") > 4, "J"), "citations": cites, "shown": F.transform("before", lambda b: b["id"])})


CLAUSES_SQL = """list_filter([CASE WHEN said != 'PASS' AND (has_value OR has_unit) THEN 'answer_without_pass' END, CASE WHEN said = 'PASS' AND NOT has_value AND NOT has_unit THEN 'pass_without_answer' END,
  CASE WHEN has_value != has_unit THEN 'value_without_unit' END, {}, CASE WHEN has_cites AND NOT list_contains(shown, cites::VARCHAR) THEN 'unknown_citation' END], lambda v: v IS NOT NULL)"""


@query(f"WITH {SAID_SQL} SELECT o AS id, {CLAUSES_SQL.format("CASE WHEN said = 'PASS' AND NOT has_cites THEN 'no_citation' END")} AS issues FROM s")
def val_08_answer_issues(t: Tables) -> DataFrame:
    """All clauses that an answer with evidence breaks."""
    return said(t).select(F.col("o").alias("id"), contracts.answer_issues(F.col("said"), F.col("value"), F.col("unit"), F.col("citations"), F.col("shown")).alias("issues"))


@query(f"WITH {SAID_SQL} SELECT o AS id, {CLAUSES_SQL.format("CASE WHEN has_cites THEN 'cites_directly' END")} AS issues FROM s")
def val_09_direct_issues(t: Tables) -> DataFrame:
    """All clauses that a direct answer breaks."""
    return said(t).select(F.col("o").alias("id"), contracts.answer_issues(F.col("said"), F.col("value"), F.col("unit"), F.col("citations"), F.col("shown"), direct=True).alias("issues"))


@query(f"WITH {SAID_SQL} SELECT o AS id, (has_cites AND list_contains(shown, cites::VARCHAR))::INT AS known FROM s")
def val_12_citations_in_bounds(t: Tables) -> DataFrame:
    """How many citations were shown."""
    return said(t).select(F.col("o").alias("id"), contracts.in_bounds(F.col("citations"), F.col("shown")).alias("known"))


@query(f"""WITH {SAID_SQL}
SELECT o AS id, CASE WHEN has_cites AND NOT list_contains(shown, cites::VARCHAR) THEN 'ERROR' WHEN status = 'F' OR said != 'FAIL_GAP' THEN said ELSE 'ABSTAIN' END AS verdict FROM s""")
def val_22_verdicts(t: Tables) -> DataFrame:
    """Verdicts in JSON that cite earlier lines only; a gap needs a complete context."""
    s = said(t)
    content = F.to_json(F.struct(F.col("said").alias("status"), "citations", F.array().cast("array<string>").alias("missing")))
    return s.select(F.col("o").alias("id"), contracts.verdict_of(content, F.col("shown"), F.col("status") == "F").alias("verdict"))


@query(f"""WITH {SAID_SQL}
SELECT o AS id, CASE WHEN list_contains(requirements, 'ERROR') THEN 'ERROR' WHEN len(requirements) > 0 AND len(list_filter(requirements, lambda r: r != 'SUPPORTED')) = 0 AND x < 8 AND has_cites AND list_contains(shown, cites::VARCHAR) THEN 'MODEL_SUPPORTED' ELSE 'REVIEW_REQUIRED' END AS status FROM s""")
def val_06_curriculum_status(t: Tables) -> DataFrame:
    """A status from an order's requirements, its review's objection and its citations."""
    s = said(t)
    grounded = (F.size("citations") > 0) & (F.size(F.array_except("citations", "shown")) == 0)
    return s.select(F.col("o").alias("id"), contracts.curriculum_status(F.transform("before", lambda b: b["requirement"]), F.col("x") >= 8, grounded).alias("status"))


@query(f"""WITH {SAID_SQL}
SELECT o AS id, CASE WHEN len(read) < len(shown) THEN 'context_not_read' WHEN list_contains(judgments, false) != (flag = 'R') THEN 'judgments_disagree' END AS problem FROM s""")
def val_05_review_problems(t: Tables) -> DataFrame:
    """Reviews that leave out lines, or object without a judgment that fails."""
    s = said(t)
    read = F.transform(F.filter("before", lambda b: b["d"] < 9), lambda b: b["id"])
    return s.select(F.col("o").alias("id"), contracts.review_problem(read, F.col("shown"), F.transform("before", lambda b: b["holds"]), F.col("flag") == "R").alias("problem"))


@query(f"""WITH {SAID_SQL}
SELECT o AS id, CASE WHEN x > 7 THEN 'ABSTAIN' WHEN NOT list_contains(shown, cites::VARCHAR) THEN CASE WHEN status = 'F' THEN 'FAIL_GAP' ELSE 'ABSTAIN' END WHEN d = 0 THEN 'ABSTAIN' WHEN q * x = q * d THEN 'PASS' ELSE 'FAIL_LOGIC' END AS verdict FROM s""")
def rul_03_verdicts(t: Tables) -> DataFrame:
    """Verdicts from a claimed and a computed value, a definition that may be missing, and a conflict."""
    s = said(t)
    cited = F.array((F.col("supp") % 7 + 1).cast("string"))
    missing = F.size(F.array_except(cited, F.col("shown"))) > 0
    computed = F.when(F.col("d") > 0, F.col("q") * F.col("d"))
    return s.select(F.col("o").alias("id"), contracts.decision(F.col("q") * F.col("x"), computed, missing, F.col("x") > 7, F.col("status") == "F").alias("verdict"))


@query(f"WITH {SAID_SQL} SELECT o AS id, CASE WHEN said = 'FAIL_GAP' AND status != 'F' THEN 'ABSTAIN' ELSE said END AS status FROM s")
def rul_09_guarded_gaps(t: Tables) -> DataFrame:
    """Gaps that are claimed of a context that isn't complete."""
    return said(t).select(F.col("o").alias("id"), contracts.guard_gap(F.col("said"), F.col("status") == "F").alias("status"))


@query(f"""
WITH l AS ({LINES_SQL}), w AS (SELECT l_orderkey AS o, l_linenumber AS n, max_by(p_name, l_extendedprice) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
last AS (SELECT l.*, w.name FROM l JOIN w USING (o, n) QUALIFY n = max(n) OVER (PARTITION BY o))
SELECT a.o AS id, CASE WHEN a.flag = 'R' THEN 'UNRESOLVED' WHEN a.x = 0 THEN 'ERROR' WHEN b.name IS NOT NULL AND contains(b.name, string_split(a.name, ' ')[2]) THEN 'SUPPORTED' ELSE 'INVALID_EVIDENCE' END AS decision
FROM last a LEFT JOIN w b ON b.o = a.o AND b.n < a.n AND b.n = a.supp % 7 + 1""")
def val_07_witnesses(t: Tables) -> DataFrame:
    """Witnesses that cite a line for a word of the last one's part."""
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max_by("p_name", "l_extendedprice").alias("name"))
    lines = order_lines(t).join(named, ["o", "n"])
    last = lines.groupBy("o").agg(F.max("n").alias("n")).join(lines, ["o", "n"])
    shown = last.select("o", "n").alias("a").join(named.alias("b"), F.expr("a.o = b.o AND b.n < a.n")).groupBy("a.o").agg(F.collect_list(F.struct(F.col("b.n").cast("string").alias("id"), F.col("b.name").alias("text"))).alias("catalog"))
    basis = F.when(F.col("flag") == "R", "INSUFFICIENT").when(F.col("x") > 0, "STATED")
    found = contracts.witness_decision(basis, (F.col("supp") % 7 + 1).cast("string"), F.split("name", " ")[1], F.col("catalog"))
    return last.join(shown, "o", "left").select(F.col("o").alias("id"), found.alias("decision"))


def judge(request: dict) -> str | None:
    """A stand-in for a model: reads whether the passages that it is shown name a rule; one prompt makes it cite, one model is silent without passages."""
    shown = request["passages"]
    if request["model"] == "quiet" and not shown:
        return None
    stated = [p["id"] for p in shown if "rule" in p["text"]]
    cited = stated if request["prompt"] == "cite" else ["0"] if len(shown) > 4 else []
    return json.dumps({"status": "PASS" if stated else "FAIL_GAP", "citations": cited, "missing": []})


@query(f"""
WITH {SAID_SQL}, k AS (SELECT o, d, x, status, flag, list(n) AS _ FROM s GROUP BY ALL),
b AS (SELECT a.o, count(*) AS n, count(*) FILTER (WHERE b.status = 'F') AS rules FROM last a JOIN l b ON a.o = b.o AND b.n < a.n GROUP BY a.o),
near AS (SELECT a.o, max_by(b.status, b.n) = 'F' AS rule FROM last a JOIN l b ON a.o = b.o AND b.n < a.n GROUP BY a.o),
p AS (SELECT k.o, k.status = 'F' AS complete, CASE WHEN k.flag = 'R' THEN 'FAIL_GAP' ELSE 'PASS' END AS expected, coalesce(b.n, 0) AS n, coalesce(rules, 0) AS rules, coalesce(near.rule, false) AS rule FROM k LEFT JOIN b USING (o) LEFT JOIN near USING (o)),
r AS (SELECT *, CASE arm WHEN 'all' THEN n WHEN 'near' THEN least(n, 1) ELSE 0 END AS shown, CASE arm WHEN 'all' THEN rules > 0 WHEN 'near' THEN rule ELSE false END AS stated
  FROM p, (VALUES ('plain'), ('quiet')) m(model), (VALUES ('ask'), ('cite')) q(prompt), (VALUES ('all'), ('near'), ('none')) a(arm)),
v AS (SELECT *, CASE WHEN model = 'quiet' AND shown = 0 THEN 'ERROR' WHEN prompt = 'ask' AND shown > 4 THEN 'ERROR' WHEN stated THEN 'PASS' WHEN complete THEN 'FAIL_GAP' ELSE 'ABSTAIN' END AS verdict FROM r)
SELECT model, prompt, arm, count(*) AS planned, count(*) FILTER (WHERE verdict = 'ERROR') AS errors, count(*) FILTER (WHERE verdict = expected) AS exact, round(count(*) FILTER (WHERE verdict = expected) / count(*), 6) AS rate FROM v GROUP BY ALL""")
def pip_08_study(t: Tables) -> DataFrame:
    """Orders as cases of a study: two models, two prompts, and three amounts of evidence."""
    s = said(t)
    text = lambda b: F.struct(b["id"].alias("id"), F.when(b["holds"], "a rule").otherwise("a tale").alias("text"))
    every = F.transform("before", text)
    cases = s.select(F.col("o").alias("case_id"), F.lit("Is it so?").alias("question"), F.when(F.col("flag") == "R", "FAIL_GAP").otherwise("PASS").alias("expected"), (F.col("status") == "F").alias("complete"), every.alias("every"), F.slice(every, F.greatest(F.lit(1), F.size("before")), F.lit(1)).alias("last"), F.slice(every, 1, 0).alias("nothing"))
    results = studies.run_study(cases, ["plain", "quiet"], ["ask", "cite"], {"all": "every", "near": "last", "none": "nothing"}, judge)
    return studies.summary(results).select("model", "prompt", "arm", "planned", "errors", "exact", F.round("rate", 6).alias("rate"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE s2 < 40 AND b > 5) AS verified_count FROM ({NEEDED_SQL})")
def snk_16_question_export(t: Tables) -> DataFrame:
    """Generated questions written as JSON, and how many of them are verified."""
    topics = parts_with_needed(t).select(F.concat_ws(":", F.col("p_partkey").cast("string"), F.concat_ws("/", "s", "b", "s2", "b2")).alias("topic"), F.lit("medium").alias("difficulty"))

    def simple(request: dict) -> str:
        s, b, s2, _ = (int(v) for v in request["topic"].split(":")[1].split("/"))
        return json.dumps({"question": "q", "question_latex": "x", "options": {"A": f"{b} + {s}" if b > 5 else f"({b} + {s}", "B": f"{b} + {s} + 1"}, "correct_answer": "A", "solution_steps": ["Add."] if s2 < 40 else []})

    made = Rounds(t.spark, "made").keep("made", generation.generate(topics, simple, 1))
    return generation.export(made, shared_folder(t.spark, "questions"))
