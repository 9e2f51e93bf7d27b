"""Systems of definitions against a recursive evaluation."""

import random

import pytest

from quillspan.operators import definitions as d
from quillspan.operators.rounds import Rounds


def plain(rules, cases):
    out = {}
    for case, root, x, claim, preview in cases:
        own = {n: (left, right, offset, seen) for c, n, left, right, offset, seen in rules if c == case}
        needed = set()

        def value(name, above=()):
            if name is None:
                return x
            needed.add(name)
            if name in above or name not in own:
                return None
            left, right, offset, seen = own[name]
            a, b = value(left, (*above, name)), value(right, (*above, name))
            return None if a is None or b is None or not seen else a + b + offset

        v = None if preview else value(root)
        out[case] = ("PASS", None, []) if preview else ("FAIL_GAP" if v is None else "PASS" if v == claim else "FAIL_LOGIC", v, sorted(needed))
    return out


RULES = "case string, node string, left string, right string, offset long, seen boolean"
CASES = "case string, root string, x long, claim long, preview boolean"


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_equal_a_recursion(spark, seed):
    r = random.Random(seed)
    rules, cases = [], []
    for c in map(str, range(40)):
        n = r.randrange(1, 9)
        pick = lambda i: r.choice([None, *(f"n{k}" for k in (range(n + (r.random() < 0.1)) if r.random() < 0.1 else range(i + 1, n)))])
        own = [(c, f"n{i}", pick(i), pick(i), r.randrange(9), r.random() < 0.9) for i in range(n)]
        rules += own
        cases.append((c, r.choice(["n0", "n0", "n0", None]), r.randrange(5), r.randrange(60), r.random() < 0.1))
    want = plain(rules, cases)
    cases = [(c, root, x, want[c][1] if i % 2 and want[c][1] is not None else claim, p) for i, (c, root, x, claim, p) in enumerate(cases)]
    want = plain(rules, cases)
    found = {x["case"]: (x.verdict, x.value, x.needed) for x in d.verdicts(spark.createDataFrame(rules, RULES), spark.createDataFrame(cases, CASES)).collect()}
    assert found == want
    assert {"FAIL_GAP", "PASS", "FAIL_LOGIC"} <= {v for v, _, _ in want.values()}


def test_rounds_follow_the_longest_chain_and_a_restart_repeats_none(spark, tmp_path):
    chain = [("c", f"n{i}", f"n{i + 1}" if i < 6 else None, None, 1, True) for i in range(7)]
    loop = [("l", "a", "b", None, 1, True), ("l", "b", "a", None, 1, True), ("m", "a", "gone", None, 1, True)]
    cases = [("c", "n0", 3, 7 + 8 * 3, False), ("l", "a", 1, 1, False), ("m", "a", 1, 1, None)]
    rules, asked = spark.createDataFrame(chain + loop, RULES), spark.createDataFrame(cases, CASES)
    rounds = Rounds(spark, folder=f"file://{tmp_path}/r")
    first = sorted(map(tuple, d.verdicts(rules, asked, rounds).collect()))
    assert first == [("c", "PASS", 31, [f"n{i}" for i in range(7)]), ("l", "FAIL_GAP", None, ["a", "b"]), ("m", "FAIL_GAP", None, ["a", "gone"])]
    assert rounds.has("decided-7") and not rounds.has("decided-8")
    again = d.verdicts(rules.limit(0), asked, Rounds(spark, folder=f"file://{tmp_path}/r"))  # all rounds are there: the rules aren't read again
    assert sorted(map(tuple, again.collect())) == first


def test_no_cases(spark):
    assert d.verdicts(spark.createDataFrame([], RULES), spark.createDataFrame([], CASES)).count() == 0
