import json

from quillspan.operators import audit, curricula, external


def tables(spark):
    records = spark.createDataFrame([("r1", "s", 1, "The ammeter measures current in a circuit"), ("r2", "s", 2, "Voltage drives charge through wires"), ("r3", "s", 9, "Resistance comes later in chapter nine")], "id string, source_id string, position int, content string")
    targets = spark.createDataFrame([("t1", "s", 5), ("t2", "s", 0), ("t3", "other", 5)], "target_id string, target_source string, target_position int")
    needs = spark.createDataFrame([("t1", 0, "what measures current"), ("t1", 1, "voltage drives"), ("t2", 0, "current"), ("t1b", 0, "x")], "target_id string, requirement_id int, requirement string")
    return records, targets, needs


def test_statuses_with_the_offline_completion(spark, tmp_path):
    found = audit.audit(*tables(spark), f"{tmp_path}/calls")
    assert {r.target_id: r.status for r in found["targets"].collect()} == {"t1": "MODEL_SUPPORTED", "t2": "REVIEW_REQUIRED", "t3": "INPUT_REVIEW_REQUIRED"}
    assert {r.id for r in found["passages"].collect()} <= {"r1", "r2"}


def test_invented_quotes_and_unknown_ids_do_not_count(spark, tmp_path):
    invented = lambda request: json.dumps({"basis": "STATED", "evidence_id": request["passages"][0]["id"], "quote": "not there"})
    unknown = lambda request: json.dumps({"basis": "STATED", "evidence_id": "r3", "quote": "Resistance"})
    for n, completion in enumerate((invented, unknown)):
        found = audit.audit(*tables(spark), f"{tmp_path}/calls{n}", completion)
        assert {r.requirement_status for r in found["requirements"].collect()} == {"UNRESOLVED"}


def test_calls_are_repeated_with_more_room_and_kept(spark, tmp_path):
    def patient(request):
        if request["max_tokens"] < 4096:
            raise TimeoutError
        return "{}"

    requests = spark.createDataFrame([("a", "{}"), ("a", "{}"), ("b", '{"x": 1}')], "key string, request string")
    rows = external.call_all(requests, f"{tmp_path}/a", patient).collect()
    assert sorted((r.key, r.status, r.attempts, r.max_tokens) for r in rows) == [("a", "OK", 3, 4096), ("b", "OK", 3, 4096)]
    failed = external.call_all(requests, f"{tmp_path}/b", lambda request: "no json", retries=1).collect()
    assert {r.status for r in failed} == {"ERROR"} and audit


def test_generated_cases_have_the_expected_verdicts(spark):
    assert [len(curricula.trees(n)) for n in range(6)] == [1, 1, 2, 5, 14, 42]
    rows = curricula.solve(curricula.controlled_cases(spark)).collect()
    assert len(rows) == 21 * 6 and all(r.status == r.expected for r in rows)
    assert all(r.missing == ["f0"] for r in rows if r.expected == "FAIL_GAP")


def test_every_sentence_of_a_target_is_asked_about(spark):
    from quillspan.plans.stateful import sentences_of

    text = "A first sentence that is long enough. Short one.\nA third sentence that is long. Yes. The fifth sentence comes last.. "
    rows = sentences_of(spark.createDataFrame([("c", 4, text), ("d", 1, " . ")], "conv_id string, turn long, text string")).collect()
    assert [(r.target_id, r.requirement_id) for r in rows] == [("c:4", i) for i in range(5)]
    assert [r.requirement.strip() for r in rows][1::2] == ["Short one", "Yes"] and rows[4].requirement.strip() == "The fifth sentence comes last"
