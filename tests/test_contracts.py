"""Contracts, saved runs, studies, and the lists and steps of formulas, case by case."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspan.functions import latex
from quillspan.functions.vectors import hash_embedding
from quillspan.operators import contracts as c
from quillspan.operators import generation, runs, studies
from quillspan.operators.rounds import Rounds


def ask(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("r")).orderBy("i").select("r").collect()]


ANSWER = "s string, v string, u string, c array<string>, shown array<string>"
NAMES = ("s", "v", "u", "c", "shown")


def test_answers(spark):
    rows = [("PASS", "1", "J", ["a"], ["a", "b"]), ("PASS", "1", " ", ["z"], ["a"]), ("PASS", None, None, None, None), ("FAIL_GAP", "1", "J", [], []), (None, None, None, None, []), ("OTHER", None, None, [], [])]
    assert ask(spark, c.answer_issues(*map(F.col, NAMES)), rows, ANSWER) == [[], ["value_without_unit", "unknown_citation"], ["pass_without_answer", "no_citation"], ["answer_without_pass"], ["unknown_status"], ["unknown_status"]]
    assert ask(spark, c.answer_issues(*map(F.col, NAMES), direct=True), rows[:3], ANSWER) == [["cites_directly"], ["value_without_unit", "cites_directly", "unknown_citation"], ["pass_without_answer"]]
    assert ask(spark, c.in_bounds(F.col("c"), F.col("shown")), [*rows[:3], ("x", "", "", ["a", "a", "b", "q"], ["a", "b"])], ANSWER) == [1, 0, 0, 2]


def test_witnesses(spark):
    catalog = [("p", "It is so."), ("q", "Else.")]
    rows = [("STATED", "p", "is so", catalog), ("DERIVED", "q", "is so", catalog), ("STATED", "r", "is", catalog), ("STATED", "p", "", catalog), ("STATED", "p", None, catalog), ("INSUFFICIENT", "p", "is", catalog), (None, "p", "is", catalog), ("GUESS", "p", "is", catalog), ("STATED", "p", "is", None)]
    found = ask(spark, c.witness_decision(*(F.col(x) for x in "beqc")), rows, "b string, e string, q string, c array<struct<id:string,text:string>>")
    assert found == ["SUPPORTED", "INVALID_EVIDENCE", "INVALID_EVIDENCE", "INVALID_EVIDENCE", "INVALID_EVIDENCE", "UNRESOLVED", "ERROR", "ERROR", "INVALID_EVIDENCE"]


def test_statuses_and_reviews(spark):
    rows = [(["SUPPORTED"] * 2, False, True), (["SUPPORTED", "UNRESOLVED"], False, True), (["SUPPORTED", "ERROR"], False, True), ([], False, True), (None, False, True), (["SUPPORTED"], True, True), (["SUPPORTED"], False, False), (["SUPPORTED"], None, True)]
    assert ask(spark, c.curriculum_status(F.col("r"), F.col("o"), F.col("g")), rows, "r array<string>, o boolean, g boolean") == ["MODEL_SUPPORTED", "REVIEW_REQUIRED", "ERROR", *["REVIEW_REQUIRED"] * 5]
    rows = [(["a"], ["a"], [True], False), (["a"], ["a", "b"], [True], False), (["z"], ["a"], [True], False), (["a"], ["a"], [True, False], False), (["a"], ["a"], [True], True), (["a"], ["a"], [None], True), (None, None, None, False)]
    assert ask(spark, c.review_problem(*(F.col(x) for x in "rcjo")), rows, "r array<string>, c array<string>, j array<boolean>, o boolean") == [None, "context_not_read", "unknown_context", "judgments_disagree", "judgments_disagree", None, None]


def test_verdicts(spark):
    good = lambda **more: json.dumps({"status": "PASS", "citations": ["a"], "missing": [], **more})
    rows = [(good(), ["a"], False), (good(citations=["b"]), ["a"], True), (good(status="FAIL_GAP"), ["a"], True), (good(status="FAIL_GAP"), ["a"], False), (good(status="FAIL_GAP"), ["a"], None), (good(status="X"), ["a"], True), ("{", ["a"], True), (None, ["a"], True), (json.dumps({"status": "PASS"}), ["a"], True)]
    assert ask(spark, c.verdict_of(F.col("t"), F.col("e"), F.col("k")), rows, "t string, e array<string>, k boolean") == ["PASS", "ERROR", "FAIL_GAP", "ABSTAIN", "ABSTAIN", "ERROR", "ERROR", "ERROR", "ERROR"]
    rows = [(1, 1, False, False, True), (1, 2, False, False, True), (1, None, False, False, True), (1, 1, True, False, True), (1, 1, True, False, False), (1, 1, True, True, True), (None, 1, None, None, None)]
    assert ask(spark, c.decision(*(F.col(x) for x in "abmck")), rows, "a int, b int, m boolean, c boolean, k boolean") == ["PASS", "FAIL_LOGIC", "ABSTAIN", "FAIL_GAP", "ABSTAIN", "ABSTAIN", "ABSTAIN"]
    assert ask(spark, c.guard_gap(F.col("s"), F.col("k")), [("CONTROLLED_GAP", False), ("CONTROLLED_GAP", True), ("PASS", False)], "s string, k boolean") == ["UNCERTAIN", "CONTROLLED_GAP", "PASS"]


def test_saved_runs(spark):
    expected = spark.createDataFrame([(i, f"p{i}", i % 2) for i in range(6)], "key int, payload string, decision int")
    actual = spark.createDataFrame([(0, "p0", 0), (1, "other", 1), (2, "p2", 1), (3, "p3", 1), (3, "p3", 1), (4, None, 0), (9, "p9", 1)], "key int, payload string, decision int")
    assert {r.key: r.state for r in runs.check_run(expected, actual).collect()} == {0: "ok", 1: "payload", 2: "decision", 3: "repeated", 4: "payload", 5: "missing", 9: "unexpected"}


def test_a_study_counts_all_that_was_planned(spark, tmp_path):
    cases = spark.createDataFrame([(i, "q", "PASS" if i < 6 else "FAIL_GAP", i % 2 == 0, [(str(i), "rule" if i < 4 else "tale")], []) for i in range(8)], "case_id int, question string, expected string, complete boolean, full array<struct<id:string,text:string>>, none array<struct<id:string,text:string>>")
    log = tmp_path / "calls"

    def model(request):
        with open(log, "a") as f:
            f.write(f"{request['case_id']}-{request['model']}-{request['prompt']}-{request['arm']}\n")
        shown = request["passages"]
        if request["model"] == "b" and not shown:
            raise ValueError("down")
        return json.dumps({"status": "PASS" if any(p["text"] == "rule" for p in shown) else "FAIL_GAP", "citations": [p["id"] for p in shown], "missing": []})

    def run():
        return studies.run_study(cases, ["a", "b"], ["x"], {"with": "full", "without": "none"}, model, Rounds(spark, folder=f"file://{tmp_path}/s"))

    rows = {(r.case_id, r.model, r.arm): r for r in run().collect()}
    assert len(rows) == 32
    for (i, m, arm), r in rows.items():
        want = "ERROR" if m == "b" and arm == "without" else "PASS" if arm == "with" and i < 4 else "FAIL_GAP" if i % 2 == 0 else "ABSTAIN"
        assert r.verdict == want and r.exact == (want == ("PASS" if i < 6 else "FAIL_GAP"))
    made = log.read_text().split()
    found = {(r.model, r.arm): r for r in studies.summary(run()).collect()}
    assert log.read_text().split() == made  # nothing is called again
    assert {k: (r.planned, r.errors, r.exact) for k, r in found.items()} == {("a", "with"): (8, 0, 5), ("b", "with"): (8, 0, 5), ("a", "without"): (8, 0, 1), ("b", "without"): (8, 8, 0)}
    assert all(r.low <= r.rate <= r.high for r in found.values())


def test_questions_are_exported(spark, tmp_path):
    topics = spark.createDataFrame([(f"t{i}", "easy") for i in range(6)], "topic string, difficulty string")
    item = {"question": "q", "question_latex": "x", "options": {"A": "1", "B": "2"}, "correct_answer": "A"}
    made = generation.generate(topics, lambda r: None if r["topic"] == "t0" else json.dumps(item | {"solution_steps": ["s"] if r["topic"] > "t2" else []}), 2)
    counts = generation.export(made, f"file://{tmp_path}/out").first()
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert (counts.total, counts.verified_count) == (6, 3) and sorted(x["topic"] for x in lines) == [f"t{i}" for i in range(1, 6)]
    assert all(x["options"] == item["options"] and x["verified"] == (x["topic"] > "t2") for x in lines)


def test_commands_and_suspicious_patterns(spark):
    texts = [r"\frac{a}{b} \foo \mybox \ab \foo2 \alphax", "", None, r"\\ \, \in"]
    assert ask(spark, latex.unknown_commands(F.col("t")), [(t,) for t in texts], "t string") == [["foo", "foo", "alphax"], [], None, []]
    texts = ["a+-*b ===", "{} { } {x}", "x^^2 a__b", r"\1 \2a", "_abcd} _abcde} _abc _wxyz", "+-=/"]
    found = ask(spark, latex.suspicious(F.col("t")), [(t,) for t in texts], "t string")
    for text, got in zip(texts, found, strict=True):
        assert tuple(got) == tuple(len(re.findall(pattern, text)) for _, pattern in latex.SUSPICIOUS)


@pytest.mark.parametrize("text, normal, steps", [
    (r"$$x_1 + y^2$$", "x_{1} + y^{2}", {"strip_delimiters", "brace_subscripts", "brace_superscripts"}),
    (r"\frac12 \times \dfrac{a}{b}", r"\frac{1}{2} * \frac{a}{b}", {"brace_fractions", "unify_operators", "unify_fractions"}),
    (r"\begin{align*} ( a [ \text{if  b}", "( a [ if b)]", {"strip_environments", "unwrap_text", "collapse_space", "balance"}),
    ("x", "x", set()),
    (r"x_{12} e^{ab} a_bc", "x_{12} e^{ab} a_bc", set()),
])
def test_formulas_are_normalised(spark, text, normal, steps):
    found = ask(spark, latex.normalize(F.col("t")), [(text,)], "t string")[0]
    assert (found.latex, set(found.applied)) == (normal, steps) and found.applied == sorted(found.applied)


def test_validation_equals_a_stack(spark):
    from quillspan.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in QUERIES["scf_14_validation"](spark, folder).collect():
        opened, errors = [], 0
        for ch in pages[row.page_id]:
            if ch in "([{":
                opened.append(ch)
            elif ch in ")]}":
                errors += not opened or opened.pop() + ch not in ("()", "[]", "{}")
        errors += len(opened)
        assert row.errors == errors and abs(row.confidence - max(0.0, 1 - 0.1 * errors)) < 1e-6


def test_bracket_errors_equal_their_sql(spark, tmp_path):
    """Pages that are strings of random brackets: errors of all three kinds, none, no text and deep ones."""
    from quillspan.plans import ORACLES, QUERIES

    r = random.Random(4)
    texts = ["".join(r.choice("([{)]}a") for _ in range(r.randrange(0, 25))) for _ in range(300)] + ["", None, "(" * 40 + ")" * 38, "(a]{[()]}["]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {i: (e, c) for i, e, c in db.execute(ORACLES["scf_14_validation"]).fetchall()}
    got = {row.page_id: (row.errors, row.confidence) for row in QUERIES["scf_14_validation"](spark, str(tmp_path)).collect()}
    assert got == want and len({e for e, _ in want.values()}) > 8


def test_embeddings_have_length_one(spark):
    from quillspan.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in QUERIES["vec_03_embedding"](spark, folder).collect():
        v = hash_embedding(texts[row.doc_id])
        assert row.dimension == len(v) and abs(row.norm - float((v * v).sum() ** 0.5)) < 1e-3


def test_records_are_held_against_their_pins(spark):
    import hashlib

    from quillspan.operators.corpus import with_structure

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (4, None)], "id int, content string")
    anchors = spark.createDataFrame([(1, "instruction"), (3, None)], "id int, role string")
    pins = spark.createDataFrame([(1, digest("a")), (2, digest("x")), (4, digest(""))], "id int, sha256 string")
    found = sorted((r.id, r.role, r.state) for r in with_structure(records, anchors, pins).collect())
    assert found == [(1, "instruction", "ok"), (2, "unknown", "changed"), (3, "unknown", "unpinned"), (4, "unknown", "ok"), (4, "unknown", "ok")]
