"""Exact expressions as columns: a bounded reader into postfix form, and identity tests in a prime field.

An expression has whole numbers and decimals, one-letter variables, ``+ - * /``, brackets, powers with a
written integer exponent, and calls of one argument where they are asked for.  A fold
over its tokens (a shunting yard) gives its postfix form; a second fold with an array as
stack evaluates that at points of the field with PRIME elements.  Expressions are short
by LONGEST, so the folds are too.

Two rational functions that are equal agree wherever both are defined.  Two that differ,
with a difference whose numerator has degree d, agree at a random point with a chance
of at most d / PRIME (Schwartz and Zippel), so POINTS points miss a difference with a
chance of at most ``(d / PRIME) ** POINTS``; degrees above MOST_DEGREE are refused, which
keeps it below 1e-9.  Integers are taken modulo PRIME, a multiple of which would count as
0; as integers have MOST_DIGITS digits at most, that happens for written ones only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime whose squares fit a long.
PRIME = 2**31 - 1
POINTS = 3
MOST_DEGREE = 1_000_000
MOST_POWER, MOST_DIGITS = 64, 18
#: The bounds of an expression.
LONGEST, MOST_NODES, MOST_DEPTH, MOST_INTEGER = 2000, 256, 48, 10**12

_TOKEN = r"[0-9]+(?:\.[0-9]+)?|\^\s*[0-9]+|[A-Za-z_][A-Za-z_0-9]*\s*\(|[A-Za-z]|[-+*/()]|\S"
#: Operators on the stack, by how tightly they bind; ~ and # are the signs before an operand.
_ALL, _TIGHT = r"[-+*/~#]*$", r"[*/~#]*$"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def plain(latex: Column) -> Column:
    """A formula as an expression: fractions, dots, crosses and braces written out, and products where factors only stand side by side."""
    text = F.translate(F.coalesce(latex, F.lit("")), "\u2212\u2013", "--")
    for pattern, by in ((r"^\s*\$+|\$+\s*$", ""), (r"\\(?:left|right)(?![a-zA-Z])", ""), (r"\\(?:cdot|times)(?![a-zA-Z])", "*"), (r"\^\s*\{\s*([0-9]+)\s*\}", "^$1"), (r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "(($1)/($2))"), (r"(?<=[0-9A-Za-z)])\s*(?=[A-Za-z])|(?<=[0-9)])\s*(?=\()|(?<=[A-Za-z)])\s*(?=[0-9])", "*")):
        text = F.regexp_replace(text, pattern, by)
    return F.translate(text, "{}", "()")


def _spaced(popped: Column) -> Column:
    return F.regexp_replace(F.reverse(popped), "(.)", " $1")


def postfix(text: Column, calls: bool = False) -> Column:
    """The postfix form, its tokens separated by blanks; null if the text isn't an expression or is longer than LONGEST. A call is ``@``, the signs are ``~`` and ``#``."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, r"\s", ""))
    state = lambda out, ops, last, good: F.struct(out.alias("out"), ops.alias("ops"), last.alias("last"), good.alias("good"))
    # last: what stood before: o an operand, p a power, b anything after which an operand has to come
    start = state(F.lit(""), F.lit(""), F.lit("b"), F.lit(True))

    def step(s: Column, t: Column) -> Column:
        out, ops, good, before = s["out"], s["ops"], s["good"], s["last"] == "b"
        operand = state(F.concat(out, F.lit(" "), t), ops, F.lit("o"), good & before)
        opened = state(out, F.concat(ops, F.when(t == "(", F.lit("(")).otherwise(F.lit("@"))), F.lit("b"), good & before & ((t == "(") | F.lit(calls)))
        signed = state(out, F.concat(ops, F.translate(t, "-+", "~#")), F.lit("b"), good & t.isin("-", "+"))
        popped = F.when(t.isin("*", "/"), F.regexp_extract(ops, _TIGHT, 0)).otherwise(F.regexp_extract(ops, _ALL, 0))
        left = lambda p: F.substring(ops, F.lit(1), F.length(ops) - F.length(p))
        binary = let(popped, lambda p: state(F.concat(out, _spaced(p)), F.concat(left(p), t), F.lit("b"), good))
        call = lambda p: F.when(left(p).endswith("@"), F.lit(" @")).otherwise(F.lit(""))
        closed = let(popped, lambda p: state(F.concat(out, _spaced(p), call(p)), F.substring(ops, F.lit(1), F.length(ops) - F.length(p) - 1), F.lit("o"), good & ~before & (F.length(ops) > F.length(p))))
        power = state(F.concat(out, F.lit(" "), t), ops, F.lit("p"), good & (s["last"] == "o") & t.rlike(r"^\^[0-9]{1,2}$"))
        made = F.when(~good, s).when(t.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), operand).when(t.endswith("("), opened).when(t.startswith("^"), power).when(t.rlike("^[A-Za-z]$"), operand)
        return made.when(t == ")", closed).when(t.isin("-", "+", "*", "/"), F.when(before, signed).otherwise(binary)).otherwise(state(out, ops, F.lit("b"), F.lit(False)))

    def finish(whole: Column) -> Column:
        end = F.regexp_extract(whole["ops"], _ALL, 0)
        good = whole["good"] & (whole["last"] != "b") & (end == whole["ops"])
        return F.when(good, F.ltrim(F.concat(whole["out"], _spaced(end))))

    return F.when(F.length(text) <= LONGEST, let(F.aggregate(tokens, start, step), finish))


def _times(a: Column, b: Column) -> Column:
    return a * b % PRIME


def _power(base: Column, exponent: Column) -> Column:
    """base ** exponent in the field; exponent is a small whole number."""
    one = F.lit(1).cast("long")
    return F.when(exponent == 0, F.when(base.isNotNull(), one)).otherwise(F.aggregate(F.array_repeat(base, exponent), one, _times))


def _inverse(b: Column) -> Column:
    """1 / b in the field by b ** (PRIME - 2), bit by bit; null for 0."""
    bits = F.array(*(F.lit(x) for x in bin(PRIME - 2)[2:]))
    step = lambda acc, bit: _times(_times(acc, acc), F.when(bit == "1", b).otherwise(F.lit(1).cast("long")))
    return F.when(b != 0, F.aggregate(bits, F.lit(1).cast("long"), step))


def evaluate(form: Column, point: int, x: Column | None = None) -> Column:
    """The value of a postfix form at a point of the field: every variable has a value by its name and the point, ``x`` that of the column if one is given. Null where it isn't defined."""
    value = lambda t: F.pmod(F.xxhash64(t, F.lit(point)), F.lit(PRIME)).cast("long")
    variable = value if x is None else lambda t: F.when(t == "x", x).otherwise(value(t))
    top = lambda s, n: F.element_at(s, -n)
    tenth = F.lit(pow(10, -1, PRIME))

    def number(t: Column) -> Column:
        digits = F.pmod(F.replace(t, F.lit("."), F.lit("")).try_cast("long"), F.lit(PRIME))
        places = F.length(t) - F.instr(t, ".")
        return F.when(t.contains("."), _times(digits, _power(tenth.cast("long"), places))).otherwise(digits)

    def step(s: Column, t: Column) -> Column:
        a, b = top(s, 2), top(s, 1)
        rest = lambda n: F.slice(s, F.lit(1), F.size(s) - n)
        push = lambda n, v: F.array_append(rest(n), v.cast("long"))
        two = F.when(t == "+", (a + b) % PRIME).when(t == "-", (a - b + PRIME) % PRIME).when(t == "*", _times(a, b)).otherwise(_times(a, _inverse(b)))
        made = F.when(t.rlike("^[0-9]"), push(0, number(t))).when(t.rlike("^[A-Za-z]"), push(0, variable(t)))
        made = made.when(t == "~", push(1, (PRIME - b) % PRIME)).when(t == "#", s).when(t.startswith("^"), push(1, _power(b, F.substring(t, 2, 3).try_cast("int"))))
        return made.otherwise(push(2, two))

    return F.element_at(F.aggregate(F.split(form, " "), F.array().cast("array<bigint>"), step), -1)


def degree(form: Column) -> Column:
    """A bound on the degrees of numerator and denominator of a postfix form, as a struct of doubles n and d."""
    pair = lambda n, d: F.struct(n.cast("double").alias("n"), d.cast("double").alias("d"))

    def step(s: Column, t: Column) -> Column:
        a, b = F.element_at(s, -2), F.element_at(s, -1)
        push = lambda n, v: F.array_append(F.slice(s, F.lit(1), F.size(s) - n), v)
        e = F.substring(t, 2, 3).try_cast("int")
        added = pair(F.greatest(a["n"] + b["d"], b["n"] + a["d"]), a["d"] + b["d"])
        made = F.when(t.rlike("^[0-9]"), push(0, pair(F.lit(0), F.lit(0)))).when(t.rlike("^[A-Za-z]"), push(0, pair(F.lit(1), F.lit(0))))
        made = made.when(t.isin("~", "#"), s).when(t.startswith("^"), push(1, pair(b["n"] * e, b["d"] * e)))
        made = made.when(t.isin("+", "-"), push(2, added)).when(t == "*", push(2, pair(a["n"] + b["n"], a["d"] + b["d"])))
        return made.otherwise(push(2, pair(a["n"] + b["d"], a["d"] + b["n"])))

    return F.element_at(F.aggregate(F.split(form, " "), F.array().cast("array<struct<n:double,d:double>>"), step), -1)


def readable(form: Column) -> Column:
    """Whether a postfix form can be evaluated: integers of MOST_DIGITS digits and powers of MOST_POWER at most, degrees in bounds."""
    small = ~F.replace(form, F.lit("."), F.lit("")).rlike(rf"[0-9]{{{MOST_DIGITS + 1}}}") & ~form.rlike(r"\^(?:6[5-9]|[7-9][0-9])")
    return F.coalesce(form.isNotNull() & small & let(degree(form), lambda d: (d["n"] <= MOST_DEGREE) & (d["d"] <= MOST_DEGREE)), F.lit(False))


def equivalence(left: Column, right: Column, x: Column | None = None) -> Column:
    """EQUIVALENT, DIFFERENT, UNDEFINED (at every point) or UNSUPPORTED, for two postfix forms. ``x``: values for the variable x, one for each point, as an array."""
    pair = lambda l, r, point: F.struct(evaluate(l, point, None if x is None else F.get(x, F.lit(point))).alias("l"), evaluate(r, point, None if x is None else F.get(x, F.lit(point))).alias("r"))  # noqa: E731, E741

    def compare(forms: Column) -> Column:
        pairs = F.array(*(pair(forms["l"], forms["r"], point) for point in range(POINTS)))
        both = let(F.filter(pairs, lambda v: v["l"].isNotNull() & v["r"].isNotNull()), lambda known: F.when(F.size(known) == 0, "UNDEFINED").when(F.forall(known, lambda v: v["l"] == v["r"]), "EQUIVALENT").otherwise("DIFFERENT"))
        return F.when(readable(forms["l"]) & readable(forms["r"]), both).otherwise("UNSUPPORTED")

    return let(F.struct(left.alias("l"), right.alias("r")), compare)


def values_at_points(form: Column) -> Column:
    """The values of a postfix form at all points, as an array."""
    return F.array(*(evaluate(form, point) for point in range(POINTS)))


def verify_parse(latex: Column) -> Column:
    """``parse`` if a formula can be read, else ``soft`` if it looks like mathematics with its brackets in balance, else ``invalid``."""
    text = F.coalesce(latex, F.lit(""))
    count = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    balanced = (count("(") == count(")")) & (count("{") == count("}"))
    looks = text.rlike(r"[=+^<>\u2264\u2265]|\\[a-zA-Z]+|[0-9]\s*[-*/]\s*[0-9a-z]")
    return F.when(let(postfix(plain(text)), readable), "parse").when(balanced & looks, "soft").otherwise("invalid")


def verify_answer(question: Column, answer: Column, distractors: Column) -> Column:
    """A struct: what verify_parse says of the answer; whether it solves the question, if that is an equation in x (else null); the numbers of the distractors that can't be read, and of those that equal the answer."""
    sides = F.split(question, "=")
    side = lambda n: postfix(plain(F.get(sides, F.lit(n))))
    numbered = F.transform(distractors, lambda d, i: F.struct(i.alias("i"), d.alias("d")))
    unread = F.transform(F.filter(numbered, lambda n: verify_parse(n["d"]) == "invalid"), lambda n: n["i"])

    def judge(form: Column) -> Column:
        solves = let(values_at_points(form), lambda at: equivalence(side(0), side(1), at) == "EQUIVALENT")
        equal = F.transform(F.filter(numbered, lambda n: equivalence(form, postfix(plain(n["d"]))) == "EQUIVALENT"), lambda n: n["i"])
        return F.struct(verify_parse(answer).alias("answer"), F.when(question.contains("="), readable(form) & (F.size(sides) == 2) & solves).alias("solves"), unread.alias("unreadable"), equal.alias("equal"))

    return let(postfix(plain(answer)), judge)


def bounded(text: Column) -> Column:
    """How an integer expression in x with ``+ - *`` and calls of one argument stands to the bounds of an expression: ``ok`` or the first bound that it breaks.

    In this order: length, syntax, nodes (a name, a sign, an operator and a call count
    as two, as their parts do), depth (an operand has 0), integers.  The name of a call stands without brackets.
    """
    def step(s: Column, t: Column) -> Column:
        a, b = F.element_at(s, -2), F.element_at(s, -1)
        push = lambda n, v: F.array_append(F.slice(s, F.lit(1), F.size(s) - n), v)
        return F.when(t.rlike("^[0-9A-Za-z]"), push(0, F.lit(0))).when(t.isin("~", "#", "@"), push(1, b + 1)).otherwise(push(2, F.greatest(a, b) + 1))

    def check(tokens: Column) -> Column:
        size = lambda *which: F.size(F.filter(tokens, lambda t: t.isin(*which)))
        integers = F.filter(tokens, lambda t: t.rlike("^[0-9]"))
        nodes = F.size(integers) + 2 * size("x", "~", "#", "+", "-", "*") + 3 * size("@")
        depth = F.element_at(F.aggregate(tokens, F.array().cast("array<int>"), step), -1)
        known = F.forall(tokens, lambda t: t.isin("x", "~", "#", "+", "-", "*", "@") | t.rlike("^(?:0+|[1-9][0-9]*)$"))
        large = F.exists(integers, lambda t: (F.length(t) > 13) & ~t.rlike("^0+$") | (t.try_cast("decimal(38,0)") > MOST_INTEGER))
        checks = F.when(tokens.isNull() | ~known, "unsupported_expression_syntax").when(nodes > MOST_NODES, "expression_node_bound")
        return checks.when(depth > MOST_DEPTH, "expression_depth_bound").when(large, "integer_bound").otherwise("ok")

    return F.when(F.length(text) > LONGEST, "expression_length_bound").otherwise(let(F.split(postfix(F.trim(text), calls=True), " "), check))
