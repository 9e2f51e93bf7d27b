"""Expressions: postfix forms, identity tests and bounds against Python's own reader and exact fractions."""

import ast
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspan.functions import algebra as a


def ask(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", column.alias("r")).orderBy("i").select("r").collect()]


def made(r, depth):
    if depth == 0 or r.random() < 0.25:
        return r.choice(["x", "y", str(r.randrange(6))])
    kind = r.randrange(7)
    one, two = made(r, depth - 1), made(r, depth - 1)
    return [f"({one} + {two})", f"({one}-{two})", f"{one}*{two}", f"({one})*({two})", f"-{one}" if not one.startswith("-") else one, f"({one})^{r.randrange(4)}", f"({one})/({two})"][kind]


def value(text, **values):
    import re

    source = re.sub(r"(?<!\*\*)\b(\d+)\b", r"F(\1)", text.replace("^", "**"))
    try:
        return eval(source, {"__builtins__": {}, "F": Fraction}, values)  # noqa: S307
    except ZeroDivisionError:
        return None


def postfix_value(form, **values):
    stack = []
    for t in form.split(" "):
        if t[0].isdigit():
            stack.append(Fraction(t))
        elif t.isalpha():
            stack.append(values[t])
        elif t in "~#":
            stack.append(-stack.pop() if t == "~" else stack.pop())
        elif t[0] == "^":
            stack.append(stack.pop() ** int(t[1:]))
        else:
            y, x = stack.pop(), stack.pop()
            if t == "/" and y == 0:
                return None
            stack.append(x + y if t == "+" else x - y if t == "-" else x * y if t == "*" else x / y)
    assert len(stack) == 1
    return stack[0]


def test_postfix_has_the_value_of_the_text(spark):
    r = random.Random(5)
    texts = [made(r, 4) for _ in range(300)] + ["-x*y", "- -x", "2 - -3*x", "+x", "-(x+1)^2", "7/2/x", "x-y-1", "x - (y - 1)"]
    forms = ask(spark, a.postfix(F.col("e")), [(t,) for t in texts], "e string")
    for text, form in zip(texts, forms, strict=True):
        assert form is not None, text
        for x, y in ((Fraction(3), Fraction(7)), (Fraction(-2, 5), Fraction(11))):
            want = value(text, x=x, y=y)
            got = postfix_value(form, x=x, y=y)
            assert got == want or want is None, (text, form)


def test_what_is_no_expression_is_refused(spark):
    texts = ["", " ", "x+", "*x", "(x", "x)", "x y", "x(", "()", "x^^2", "x^y", "2^3^2", "x^-1", "1.", ".5", "f(x)", "x$", "x=1", None, "x" + "+x" * 1000, "x^1000"]
    assert ask(spark, a.postfix(F.col("e")), [(t,) for t in texts], "e string") == [None] * len(texts)
    assert ask(spark, a.postfix(F.col("e"), calls=True), [("f(x+1)*g_2( 3 )",)], "e string") == ["x 1 + @ 3 @ *"]


def test_values_in_the_field(spark):
    p = a.PRIME
    texts = ["0.25", "12.50", "2", "1/3", "7/0", "(5-9)*2", "3^0", "0^0", "2^40", "1/(2-2)"]
    want = [pow(4, -1, p), 25 * pow(2, -1, p) % p, 2, pow(3, -1, p), None, p - 8, 1, 1, 2**40 % p, None]
    assert ask(spark, a.evaluate(a.postfix(F.col("e")), 0), [(t,) for t in texts], "e string") == want


def test_equal_and_unequal_pairs_are_told_apart(spark):
    r = random.Random(8)
    pairs = [("(x+y)^2", "x^2+2xy+y^2"), ("(x^2-1)/(x-1)", "x+1"), ("1/x+1/y", "(x+y)/(xy)"), ("(x+1)^3", "x^3+3x^2+3x+1"), ("\\frac{x}{2} \\cdot 4", "2x"), ("$x^{2}$", "x*x")]
    for _ in range(40):
        u, v, w = (made(r, 2) for _ in range(3))
        pairs.append((f"({u})*(({v})+({w}))", f"({u})*({v})+({u})*({w})"))
    different = [("(x+y)^2", "x^2+y^2"), ("x/y", "y/x"), ("x", "x+1"), ("x^2", "x^3"), ("xy", "yz")] + [(u, f"({u})+1") for u, _ in pairs[6:26]]
    status = ask(spark, a.equivalence(a.postfix(a.plain(F.col("l"))), a.postfix(a.plain(F.col("r")))), pairs + different, "l string, r string")
    for (left, right), s in zip(pairs + different, status, strict=True):
        points = [(Fraction(2), Fraction(5)), (Fraction(7, 3), Fraction(11)), (Fraction(-5), Fraction(13, 2))]
        if s == "UNDEFINED":
            assert all(value(left, x=x, y=y) is None for x, y in points), (left, right)
    assert set(status[: len(pairs)]) <= {"EQUIVALENT", "UNDEFINED"} and status[:6] == ["EQUIVALENT"] * 6
    assert set(status[len(pairs) :]) <= {"DIFFERENT", "UNDEFINED"} and status[len(pairs) : len(pairs) + 5] == ["DIFFERENT"] * 5


def test_refused_pairs_and_the_bound_of_the_degree(spark):
    refused = [("x+", "x"), ("x", None), ("f(x)", "x"), ("(((x^64)^64)^64)^64", "x"), ("1" * 19, "x"), ("x^65", "x")]
    assert ask(spark, a.equivalence(a.postfix(F.col("l")), a.postfix(F.col("r"))), refused, "l string, r string") == ["UNSUPPORTED"] * 6
    assert ask(spark, a.equivalence(a.postfix(F.col("l")), a.postfix(F.col("r"))), [("1/(x-x)", "2/(y-y)")], "l string, r string") == ["UNDEFINED"]
    degrees = ask(spark, a.degree(a.postfix(F.col("e"))), [("x*y^2-1",), ("1/x+1/(y^3)",), ("7",)], "e string")
    assert [tuple(d) for d in degrees] == [(3.0, 0.0), (3.0, 4.0), (0.0, 0.0)]
    assert (a.MOST_DEGREE * 2 / a.PRIME) ** a.POINTS < 1e-8


def test_answers_and_distractors(spark):
    rows = [("2*x + 3 = 11", "4", ["8/2", "5", "4.0", "x", "4..0"]), ("x^2 = 9", "-3", ["3"]), ("x + a = b", "b - a", ["a-b", "-(a-b)"]), ("what", "x+", []), ("1 = 2 = 3", "1", ["2"])]
    found = ask(spark, a.verify_answer(F.col("q"), F.col("a"), F.col("d")), rows, "q string, a string, d array<string>")
    assert [(f.answer, f.solves, f.unreadable, f.equal) for f in found] == [("parse", True, [4], [0, 2]), ("parse", True, [], []), ("parse", True, [], [1]), ("soft", None, [], []), ("parse", False, [], [])]


def python_bound(text):
    """The bounds by Python's own parser (syntax first, then nodes, depth, integers)."""
    if len(text) > a.LONGEST:
        return "expression_length_bound"
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        return "unsupported_expression_syntax"
    worst = [0, 0]

    def known(node, depth=0):
        worst[0] = max(worst[0], depth)
        if isinstance(node, ast.Constant) and type(node.value) is int:
            worst[1] = max(worst[1], node.value)
            return True
        if isinstance(node, ast.Name):
            return node.id == "x"
        if isinstance(node, ast.UnaryOp):
            return isinstance(node.op, ast.UAdd | ast.USub) and known(node.operand, depth + 1)
        if isinstance(node, ast.BinOp):
            return isinstance(node.op, ast.Add | ast.Sub | ast.Mult) and known(node.left, depth + 1) & known(node.right, depth + 1)
        return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1 and not node.keywords and known(node.args[0], depth + 1)

    if not known(tree):
        return "unsupported_expression_syntax"
    if sum(1 for _ in ast.walk(tree)) > a.MOST_NODES:
        return "expression_node_bound"
    return "expression_depth_bound" if worst[0] > a.MOST_DEPTH else "integer_bound" if worst[1] > a.MOST_INTEGER else "ok"


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_equal_pythons_parser(spark, seed):
    r = random.Random(seed)

    def expr(d):
        if d == 0 or r.random() < 0.2:
            return r.choice(["x", "7", str(r.randrange(3 * 10**12)), "x", "00", "07", "y"][: 5 if r.random() < 0.95 else 7])
        u, v = expr(d - 1), expr(d - 1)
        return r.choice([f"{u} + {v}", f"({u})-{v}", f"f({u})", f"-{u}", f"{u}*({v})", f"+({u})", f"{u}/{v}" if r.random() < 0.1 else f"{u}*{v}"])

    texts = [expr(r.randrange(1, 6)) for _ in range(150)]
    texts += ["(" * n + "x" + ")" * n for n in (1, 60)] + ["f(" * n + "x" + ")" * n for n in (48, 49)] + ["-" * n + "x" for n in (48, 49)]
    texts += ["+".join(["x"] * n) for n in (40, 49, 50, 70)] + ["1" * 12, str(10**12), str(10**12 + 1), "x" * 2001, "x +", "", "f()", "f(x", "x x"]
    assert ask(spark, a.bounded(F.col("e")), [(t,) for t in texts], "e string") == [python_bound(t) for t in texts]
