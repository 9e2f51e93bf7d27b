"""Checks of numeric claims on single questions."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import quantities as q

LAW, NONE = ["Ohm's law: V = I R (1.2)."], None
HEATER = "A heater draws 2 A at 10 V. What current does it draw at 25 V?"
CASES = [
    ("work_mapping", "What work is done by a charge of 2 C over a potential difference of 3 V?", "6", "J", ["W = Q V"], q.MATCH),
    ("work_mapping", "What work is done by a charge of 2 C over a potential difference of 3 V?", "7", "J", ["W = Q V"], q.CONTRADICTION),
    ("work_mapping", "What work is done by a charge of 2 C over a potential difference of 3 V?", "6", "N", ["W = Q V"], q.REVIEW),
    ("work_mapping", "What work is done by a charge of 2 C over a potential difference of 3 V?", None, "J", ["W = Q V"], q.REVIEW),
    ("work_mapping", "What work is done by a charge of 1234567 C over a potential difference of 3 V?", "6", "J", ["W = Q V"], q.CONTRADICTION),
    ("work_mapping", "What work is done by a charge of 1234567.0000001 C over a potential difference of 3 V?", "3703701.0000003", "J", ["W = Q V"], q.MATCH),
    ("work_mapping", "What work is done by a charge of -2 C over a potential difference of 3 V?", "6", "J", ["W = Q V"], q.REVIEW),
    ("work_mapping", None, "6", "J", ["W = Q V"], q.NOT_ASSESSED),
    ("work_mapping", "How far is it?", "6", "J", NONE, q.NOT_ASSESSED),
    ("lens_mapping", "Find the power of a lens of focal length -0.5 m.", "-2", "D", ["Lens power P = 1/f."], q.MATCH),
    ("lens_mapping", "Find the power of a lens of focal length 3 m.", "1/3", "D", ["P = 1/f"], q.MATCH),
    ("lens_mapping", "Find the power of a lens of focal length 3 m.", "0.333333333", "D", ["P = 1/f"], q.CONTRADICTION),
    ("lens_mapping", "Find the power of a lens of focal length 0.00000004 m.", "25000000", "D", ["Lens power P = 1 / f when focal length f is in metres."], q.MATCH),
    ("lens_mapping", "Find the power of two lenses, one lens of focal length 3 m.", "1/3", "D", ["P = 1/f"], q.REVIEW),
    ("lens_mapping", "Find the power of a lens of focal length 0 m.", "1", "D", ["P = 1/f"], q.REVIEW),
    ("lens_mapping", "Find the power of a lens of focal length 3 m.", "1/0", "D", ["P = 1/f"], q.REVIEW),
    ("lens_mapping", "Find the power of a lens of focal length 3 m.", "1/3", "D", ["P = 1/f is wrong"], q.REVIEW),
    ("heater_mapping", HEATER, "5", "A", LAW, q.MATCH),
    ("heater_mapping", HEATER, "5000", "mA", LAW, q.MATCH),
    ("heater_mapping", HEATER, "6", "A", LAW, q.CONTRADICTION),
    ("heater_mapping", HEATER, "5", "A", NONE, q.REVIEW),
    ("heater_mapping", HEATER.replace("draws 2 A", "is heated and draws 2 A"), "5", "A", LAW, q.REVIEW),
    ("heater_mapping", "", "5", "A", LAW, q.NOT_ASSESSED),
]


@pytest.mark.parametrize("name,question,claim,unit,cited,status", CASES)
def test_mapping(spark, name, question, claim, unit, cited, status):
    df = spark.createDataFrame([(question, claim, unit, cited)], "q string, c string, u string, e array<string>")
    assert df.select(getattr(q, name)(F.col("q"), F.col("c"), F.col("u"), F.col("e"))).first()[0] == status


def test_condition_asked_is_not_stated(spark):
    stated = HEATER + " Assume constant resistance."
    df = spark.createDataFrame([(HEATER, LAW), (stated, LAW), (HEATER + " Is it a constant resistance?", LAW), (None, LAW)], "q string, e array<string>")
    assert [r[0] for r in df.select(q.resistance_condition(F.col("q"), F.col("e"))).collect()] == ["CONDITION_REQUIRED", "CONDITION_STATED", q.REVIEW, q.NOT_ASSESSED]


def test_reading():
    t = q.read("A heater (12.5 kV, -3 mA) isn't at x-1 or 1e5 V.")
    assert [(x.of, x.value) for x in t if x.of] == [("voltage", 12500), ("current", -q.Fraction(3, 1000))]
    assert q.read(None) == q.read("") == [] and q.number("1" * 31) is None and q.number("1.5.2") is None and q.number("²") is None
    assert q.formulas(["Ohm's law: V = I * R (1.2).\nW = Q V;", None]) >= {"V=IR", "W=QV"} and q.formulas(None) == set()


def test_resistances_are_compared_exactly():
    question, law = "A heater is at 10 V when it draws 0.003 A. What is its resistance?", ["R = V / I"]
    assert q.check_resistance("A heater is at 0.9 V when the heater draws a current of 3 mA.", ["Its resistance is 300 Ω."], law) == "CONSISTENT_WITHIN_SCOPE"
    assert q.check_resistance(question, ["The resistance is 3333.3333 ohms."], law) == q.CONTRADICTION
    assert q.check_resistance(question, ["The resistance is about 3333 ohms."], law) == q.NOT_ASSESSED
    assert q.check_resistance(question, None, None) == q.check_resistance(None, ["The resistance is 1 Ω"], law) == q.NOT_ASSESSED
