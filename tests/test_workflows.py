"""Guards, rounds of generation, extraction, controls and the resumable sink, against plain loops and after kills."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import cascade, controls, extraction, generation, questions
from quillspan.operators.rounds import Rounds
from quillspan.streaming import commits


def test_each_row_is_decided_by_the_first_guard_that_objects(spark):
    rows = spark.range(60).withColumn("v", F.col("id") % 6)
    asked = spark.sparkContext.accumulator(0)

    def look(df):
        seen = F.udf(lambda v: asked.add(1) or int(v), "int")
        return df.withColumn("w", seen("v"))

    stages = [
        cascade.Stage("first", (("zero", F.when(F.col("v") == 0, "A")), ("even", F.when(F.col("v") == 2, "B")))),
        cascade.Stage("second", (("three", F.when(F.col("w") == 3, F.concat(F.lit("C"), F.col("w").cast("string")))), ("low", F.when(F.col("w") < 4, "D"))), look),
    ]
    found = cascade.decide(rows, stages, F.concat(F.lit("P"), F.col("w").cast("string")))
    got = {r.id: (r.status, r.guard) for r in found.collect()}
    plain = {0: ("A", "zero"), 1: ("D", "low"), 2: ("B", "even"), 3: ("C3", "three"), 4: ("P4", "none"), 5: ("P5", "none")}
    assert got == {i: plain[i % 6] for i in range(60)} and found.columns == ["id", "v", "status", "guard"]
    assert asked.value == 40  # open rows only, once
    assert sum(r.n for r in cascade.counts(found).collect()) == 60


def test_later_guards_are_not_evaluated_for_decided_rows(spark):
    fails = F.when(F.col("id") >= 0, F.raise_error(F.lit("evaluated")).cast("string"))
    stages = [cascade.Stage("s", (("all", F.lit("X")), ("never", fails)))]
    assert cascade.decide(spark.range(5), stages, F.lit("P")).where("guard = 'all'").count() == 5


def test_questions_pass_or_stop_at_one_guard(spark):
    base = {"question": "How much work moves a charge of 3 C across a potential difference of 9 V?", "background": "", "source": "s", "before": 5, "region": None}
    answer = {"verdict": "PASS", "cited": ["p1"], "missing": [], "expression": "3*9", "claimed": "27", "unit": "J", "statements": []}
    cases = [
        ("ok", {}, {}, "ARITHMETIC_CHECKED", "none"),
        ("region", {"region": "box"}, {}, "INPUT_REVIEW_REQUIRED", "region"),
        ("figure", {"question": "See Fig. 3. What is it?"}, {}, "INPUT_REVIEW_REQUIRED", "figure"),
        ("first", {"before": 0}, {}, "ERROR", "no_evidence"),
        ("silent", {}, None, "ERROR", "no_judgment"),
        ("later", {}, {"cited": ["p9"]}, "ERROR", "citation"),
        ("conflict", {}, {"verdict": "FAIL_GAP"}, "ERROR", "conflicting_answer"),
        ("gap", {}, {"verdict": "FAIL_GAP", "expression": None, "claimed": " ", "unit": None}, "FAIL_GAP", "verdict"),
        ("uncited", {}, {"cited": []}, "ABSTAIN", "no_citation"),
        ("lacking", {}, {"missing": ["x"]}, "ABSTAIN", "no_citation"),
        ("blank", {}, {"unit": " "}, "ABSTAIN", "no_answer"),
        ("wrong", {}, {"claimed": "28"}, "REJECTED_CALCULATION", "calculation"),
        ("unread", {}, {"expression": "3**9"}, "REJECTED_CALCULATION", "calculation"),
        ("other", {}, {"expression": "4*9", "claimed": "36"}, "QUANTITY_REVIEW_REQUIRED", "work"),
        ("ruleless", {}, {"cited": ["p2"]}, "QUANTITY_REVIEW_REQUIRED", "work"),
        ("numbers", {"question": "What is the sum of 3 and 9?"}, {"expression": "3+9+1-1", "claimed": "12", "unit": "1"}, "SOURCE_REVIEW_REQUIRED", "numbers"),
    ]
    asked = spark.createDataFrame([(i, *({**base, **q}).values()) for i, q, *_ in cases], "id string, question string, background string, source string, before long, region string")
    judged = spark.createDataFrame([(i, *({**answer, **j}).values()) for i, _, j, *_ in cases if j is not None], "id string, verdict string, cited array<string>, missing array<string>, expression string, claimed string, unit string, statements array<string>")
    passages = spark.createDataFrame([("s", 1, "p1", "We read:\nW = V Q"), ("s", 2, "p2", "Nothing."), ("s", 9, "p9", "W = V Q"), ("t", 0, "p0", "W = V Q")], "source string, position long, id string, text string")
    found = {r.id: (r.status, r.guard) for r in questions.audit_questions(asked, passages, judged).collect()}
    assert found == {i: (status, guard) for i, _, _, status, guard in cases}


def writer(log, stop_at=None):
    """A model that writes worse items first, and leaves a trace of each call."""

    def complete(request):
        with open(log, "a") as f:
            f.write(f"{request['topic']}:{request['attempt']}\n")
        n, attempt = int(request["topic"][1:]), request["attempt"]
        if stop_at == attempt:
            raise SystemExit("killed")
        if n % 5 == 4:
            return None if n % 2 else "[]"
        good = attempt > n % 4
        options = {"A": "x+1", "B": "x+2", "C": "1+x" if not good else "x-1"}
        if request["feedback"] and n % 4 == 3:
            assert "equivalent" in request["feedback"]
        return json.dumps({"question": "q", "question_latex": "l", "options": options, "correct_answer": "A", "solution_steps": ["s"] if good or n % 2 else []})

    return complete


def test_rounds_of_generation(spark, tmp_path):
    log = tmp_path / "calls"
    topics = spark.createDataFrame([(f"t{i}", "medium") for i in range(20)], "topic string, difficulty string")
    made = {r.topic: r for r in generation.generate(topics, writer(str(log)), rounds=Rounds(spark, folder=f"file://{tmp_path}/r")).collect()}
    assert len(made) == 20
    for i in range(20):
        r = made[f"t{i}"]
        if i % 5 == 4:
            assert (r.verified, r.attempts, r.item) == (False, 3, None) and r.errors == [f"Attempt {k}: Generation failed" for k in (1, 2, 3)]
        elif i % 4 == 3:
            assert (r.verified, r.attempts) == (False, 3) and r.errors == ["Distractor 2 is equivalent to correct answer"] * 3 and r.item.options["C"] == "1+x"
        else:
            assert (r.verified, r.attempts, r.confidence, r.errors) == (True, i % 4 + 1, 1.0, [])
        assert r.verified or abs(r.confidence - 0.2) < 1e-9
    wanted = sorted(f"t{i}:{k}" for i in range(20) for k in range(1, (3 if i % 5 == 4 or i % 4 == 3 else i % 4 + 1) + 1))
    assert sorted(set(log.read_text().split())) == wanted


def test_a_run_that_was_killed_repeats_no_call(spark, tmp_path):
    log, folder = tmp_path / "calls", f"file://{tmp_path}/r"
    topics = spark.createDataFrame([(f"t{i}", "medium") for i in range(12) if i % 5 != 4], "topic string, difficulty string")
    rounds = Rounds(spark, folder=folder)
    keep = rounds.keep

    def killed(name, make):
        if name == "judged-2":  # after the calls of the second round are written
            raise KeyboardInterrupt
        return keep(name, make)

    rounds.keep = killed
    with pytest.raises(KeyboardInterrupt):
        generation.generate(topics, writer(str(log)), rounds=rounds)
    before = sorted(log.read_text().split())
    assert {c.split(":")[1] for c in before} == {"1", "2"}
    made = generation.generate(topics, writer(str(log)), rounds=Rounds(spark, folder=folder)).collect()
    after = log.read_text().split()
    assert len(made) == 10 and sorted(c for c in after if not c.endswith(":3")) == before
    assert len(after) == len(set(after))


def test_quotes_are_located_in_the_raw_text(spark):
    rows = [("a  b\n c. d", "b c."), ("a  b\n c. d", "A B"), ("x.y", "x y"), ("aXbX", "."), ("t", ""), ("t", None), (None, "t"), ("q\\E(r)  [s", "\\E(r) [s"), ("é  É", "é é")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, q string")
    found = [r[0] and tuple(r[0]) for r in df.orderBy("i").select(extraction.located(F.col("t"), F.col("q"))).collect()]
    for (text, quote), got in zip(rows, found, strict=True):
        words = [re.escape(w) for w in (quote or "").split()]
        m = re.search(r"\s+".join(words), text, re.I) if words and text else None
        assert got == (m and m.span()), (text, quote)


def test_claims_are_accepted_or_have_a_reason(spark):
    text = ["The ammeter measures  the current.", "Is it charged?", "An ammeter means a meter.", "Current is strong."]
    units = spark.createDataFrame([("s", i, t, 100 * i, 100 * i + len(t)) for i, t in enumerate(text)], "source string, unit int, content string, start long, end long")
    entities = [("e0", "ammeter", "definition", 2), ("e1", "current", "other", 0), ("e2", "volt", "other", 0), ("e3", "current", "definition", 3), ("e4", "ammeter", "formula", 0), ("e5", "charged", "other", 1), ("e6", "strong", "other", 3)]
    table = spark.createDataFrame([("s", c, n, r, u, False) for c, n, r, u in entities], "source string, claim string, name string, role string, unit int, layout_verified boolean")
    relations = spark.createDataFrame([("s", "r0", "MEASURES", "ammeter", "current", 0), ("s", "r1", "MEASURES", "current", "ammeter", 0), ("s", "r2", "MEASURES", "ammeter", "current", 9), ("s", "r3", "MEASURES", "the ammeter", "current", 0), ("s", "r4", "MEASURES", "ammeter", "current", 0)], "source string, claim string, kind string, from_name string, to_name string, unit int")
    reviews = spark.createDataFrame([("s", c, "SUPPORTED") for c in ("e0", "e1", "e2", "e3", "e4", "e5", "r0", "r1", "r2", "r3")] + [("s", "r4", "UNCERTAIN")], "source string, claim string, verdict string")
    judged = extraction.judge_entities(units, table, reviews)
    assert {r.claim: r.reason for r in judged.collect()} == {"e0": None, "e1": None, "e2": "no_literal_mention", "e3": "no_definition_wording", "e4": "layout_unverified", "e5": "unknown_evidence", "e6": "review"}
    found = {r.claim: r for r in extraction.judge_relations(units, relations, reviews, judged).collect()}
    assert {c: r.reason for c, r in found.items()} == {"r0": None, "r1": "no_directional_witness", "r2": "unknown_evidence", "r3": "endpoint_not_accepted", "r4": "review"}
    assert (found["r0"].quote_start, found["r0"].quote_end, found["r0"].quote) == (0, 33, "The ammeter measures  the current")


def test_controls_spoil_one_thing_and_the_packet_shows_none(spark):
    items = spark.createDataFrame([(1, "move 3 C", "V = W/Q\nrest", "V = W/Q", "Q", "3 C", "3 kg"), (2, "q", "s", "", None, "z", "y")], "item int, question string, source string, rule string, symbol string, unit string, other_unit string")
    cases = controls.corruption_cases(items)
    rows = {r.id: r for r in cases.collect()}
    assert rows["1_clean"].source == "V = W/Q\nrest" and rows["1_missing_rule"].source == "\nrest" and rows["1_damaged_symbol"].source == "V = W/[unreadable symbol]\nrest" and rows["1_wrong_unit"].question == "move 3 kg"
    assert {i: r.spoilt for i, r in rows.items()} == {f"{n}_{o}": n == 1 and o != "clean" for n in (1, 2) for o in controls.OPERATORS}
    packet, key = controls.blinded(cases, "seed")
    ids = {r.alias: r.id for r in key.collect()}
    assert sorted(ids) == sorted(f"R{i}" for i in range(1, 9)) and set(ids.values()) == set(rows)
    assert packet.columns == ["alias", "question", "source"] and all((r.question, r.source) == (rows[ids[r.alias]].question, rows[ids[r.alias]].source) for r in packet.collect())


def test_the_sink_has_every_key_once_after_kills(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    for part in range(4):
        spark.createDataFrame([(part * 8 + i, f"v{i}") for i in range(12)], "k long, v string").coalesce(1).write.mode("append").parquet(folder)  # each file repeats keys of the next
    stream = lambda: spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(folder)
    seen = []

    def work(rows, fail_at=None):
        seen.append(rows.count())
        if len(seen) == fail_at:
            rows.withColumn("bucket", F.lit(0)).write.parquet(f"{tmp_path}/out/batch=2/bucket=0")  # a half-written batch, without its mark
            raise RuntimeError("killed")
        return rows.withColumn("double", F.col("k") * 2)

    with pytest.raises(Exception, match="killed"):
        commits.process_once(stream(), "k", out, f"{tmp_path}/c1", lambda r: work(r, 3), 4).awaitTermination()
    assert commits.committed(spark, out).count() == seen[0] + seen[1]
    commits.process_once(stream(), "k", out, f"{tmp_path}/c1", work, 4).awaitTermination()
    keys = sorted(r.k for r in commits.committed(spark, out).collect())
    assert keys == list(range(36))
    commits.process_once(stream(), "k", out, f"{tmp_path}/c2", work, 4).awaitTermination()  # the checkpoint is lost
    assert sorted(r.k for r in commits.committed(spark, out).collect()) == keys and seen[-4:] == [0, 0, 0, 0]


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.range(64).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    rows.write.partitionBy("bucket").parquet(f"{out}/batch=0")
    done = commits.committed(spark, out, 1)
    plan = done.where(F.col("bucket").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert commits.committed(spark, out, 0) is None and commits.committed(spark, f"{out}-none") is None
