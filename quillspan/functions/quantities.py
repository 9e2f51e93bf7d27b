"""Bounded checks of a numeric claim against a question's quantities and a cited formula.

A text is read into words, numbers and marks; a number and the unit after it are a
quantity.  Each check says by words whether a question is of its kind, binds the few
quantities that it needs by their units and places, wants the formula on a line of a
cited text, and compares exact fractions.  What it can't bind it leaves to review; a
null question isn't assessed, a claim that is null or no number needs review, and null
citations are none.  Questions are single texts, so a check is a function of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scope import squeeze
from .witness import term_pattern

MATCH, CONTRADICTION, REVIEW, NOT_ASSESSED = "MATCH_WITHIN_SCOPE", "CONTRADICTION", "REVIEW_REQUIRED", "NOT_ASSESSED"

#: Unit symbols, as written, and unit names, in any case, with what they measure and their factor.
SYMBOLS = {
    "V": ("voltage", "1"), "mV": ("voltage", "0.001"), "kV": ("voltage", "1000"),
    "A": ("current", "1"), "mA": ("current", "0.001"), "µA": ("current", "0.000001"), "μA": ("current", "0.000001"),
    "Ω": ("resistance", "1"), "kΩ": ("resistance", "1000"), "C": ("charge", "1"), "m": ("length", "1"),
}
UNIT_NAMES = {
    "volt": ("voltage", "1"), "volts": ("voltage", "1"), "ampere": ("current", "1"), "amperes": ("current", "1"), "amp": ("current", "1"), "amps": ("current", "1"),
    "ohm": ("resistance", "1"), "ohms": ("resistance", "1"), "kiloohm": ("resistance", "1000"), "kiloohms": ("resistance", "1000"),
    "coulomb": ("charge", "1"), "coulombs": ("charge", "1"), "metre": ("length", "1"), "metres": ("length", "1"), "meter": ("length", "1"), "meters": ("length", "1"),
}
WORK_UNITS, POWER_UNITS = {"j", "joule", "joules"}, {"d", "dioptre", "dioptres", "diopter", "diopters"}
#: Formulas by what they say, without spaces and signs of multiplication.
OHMS_LAW, WORK_RULES = {"R=V/I", "V=IR", "I=V/R"}, {"V=W/Q", "W=VQ", "W=QV"}
#: Words that the checks look for.
DEVICES, ASKING = {"heater", "resistor", "conductor"}, {"what", "find", "calculate", "determine"}
VARYING = {"change", "changes", "varies", "vary", "increase", "increases", "decrease", "decreases", "double", "doubles", "halve", "halves", "become", "becomes"}
UNSTEADY = {"not", "never", "heated", "cooled", "unless"}
STEADY, STAYING = {"constant", "unchanged", "same"}, {"remains", "remain", "stays", "stay", "is"}
WONDERING = {"does", "is", "will", "could", "might", "whether"}
OTHER_DEVICE = {"another", "different", "other", "approximately", "about", "either", "or"}
OTHER_WORK = {"not", "negative", "decrease", "decreases", "change", "changes", "varies", "another", "second", "initial", "final"}
OTHER_LENS = {"another", "second", "two", "combination", "combined", "changes", "approximately", "about"}
DOUBTED = {"not", "incorrect", "invalid", "false", "wrong", "unreadable"}
HEDGED = {
    "not", "never", "other", "another", "second", "different", "change", "changes", "varies", "vary", "from", "to", "or", "either", "between", "approximately", "about", "roughly", "nearly", "if", "could", "might",
    "would", "were", "rise", "rises", "fall", "falls", "become", "becomes", "increase", "increases", "decrease", "decreases", "higher", "lower", "heated", "cooled", "after",
}
#: How many words after its noun a quantity or a change may stand.
NEAR = 16
LONGEST_NUMBER = 30


@dataclass
class Token:
    """A word or mark, or a number with what it measures (None: nothing known) in base units."""

    text: str
    low: str
    value: Fraction | None = None
    of: str | None = None
    signed: bool = False


def number(text: str | None) -> Fraction | None:
    """A plain decimal with an optional sign, of at most LONGEST_NUMBER characters; None for anything else."""
    plain = (text or "").strip()
    digits = plain[1:] if plain[:1] in ("+", "-") else plain
    whole, dot, part = digits.partition(".")
    ok = len(plain) <= LONGEST_NUMBER and plain.isascii() and whole.isdigit() and (part.isdigit() if dot else True)
    return Fraction(plain) if ok else None


def _run(text: str, at: int, of: Callable[[str], bool]) -> int:
    while at < len(text) and of(text[at]):
        at += 1
    return at


def read(text: str | None) -> list[Token]:
    """The tokens of a text; a unit after a number goes into the number's token."""
    out: list[Token] = []
    text, at = text or "", 0
    while at < len(text):
        c = text[at]
        sign = c in "+-" and text[at + 1 : at + 2].isdigit() and not (at and (text[at - 1].isalnum() or text[at - 1] in ".)"))
        if c.isdigit() or sign:
            end = _run(text, at + sign, str.isdigit)
            if text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit():
                end = _run(text, end + 1, str.isdigit)
            out.append(Token(text[at:end], text[at:end], number(text[at:end]), None, sign))
        elif c.isalpha() or c == "_":
            end = _run(text, at, lambda x: x.isalnum() or x in "_'’")
            word = text[at:end]
            unit = SYMBOLS.get(word) or UNIT_NAMES.get(word.lower())
            last = out[-1] if out else None
            if unit and last and last.value is not None and last.of is None:
                last.value, last.of = last.value * Fraction(unit[1]), unit[0]
            else:
                out.append(Token(word, word.lower()))
        elif c.isspace():
            end = at + 1
        else:
            end = at + 1
            out.append(Token(c, c))
        at = end
    return out


def words(tokens: Iterable[Token]) -> set[str]:
    return {t.low for t in tokens}


def of_kind(tokens: list[Token], of: str) -> list[int]:
    """Where quantities of a kind stand."""
    return [i for i, t in enumerate(tokens) if t.of == of]


def sentences(tokens: list[Token]) -> list[list[Token]]:
    """Tokens by sentence, each with its closing mark."""
    out: list[list[Token]] = [[]]
    for t in tokens:
        out[-1].append(t)
        if t.text in (".", "!", "?"):
            out.append([])
    return [s for s in out if s]


def follows(tokens: list[Token], at: int, *wanted: str) -> bool:
    """Whether these words stand from a place on."""
    return [t.low for t in tokens[at : at + len(wanted)]] == list(wanted)


def formulas(cited: Iterable[str | None] | None) -> set[str]:
    """The cited lines that may be a formula alone, without spaces, signs of multiplication, a heading, and a number in parentheses."""
    out = set()
    for line in (line for text in (() if cited is None else cited) for line in (text or "").splitlines()):
        bare = "".join(line.split()).rstrip(".;")
        head, colon, rest = bare.partition(":")
        bare = rest if colon and head.lower() in ("ohm'slaw", "ohmlaw") else bare
        body, bracket, label = bare.partition("(")
        numbered = bracket and label.endswith(")") and all(part.isdigit() for part in label[:-1].split("."))
        out.add((body.rstrip(".;") if numbered else bare).replace("*", ""))
    return out


def mentioned(cited: Iterable[str | None] | None, rules: set[str]) -> bool:
    """Whether a cited text has one of the formulas anywhere."""
    bare = ["".join((t or "").split()).replace("*", "") for t in (() if cited is None else cited)]
    return any(rule in text for text in bare for rule in rules)


def compared(left: Fraction | None, right: Fraction) -> str:
    return REVIEW if left is None else MATCH if left == right else CONTRADICTION


def unit_in(unit: str | None, names: set[str]) -> bool:
    return (unit or "").strip().lower() in names


def check_work(question: str | None, claim: str | None, unit: str | None, cited: list[str] | None) -> str:
    t = read(question)
    have = words(t)
    if not (have & {"work", "energy"} and "charge" in have and any(follows(t, i, "potential", "difference") for i in range(len(t)))):
        return NOT_ASSESSED
    charges, volts = ([t[i] for i in of_kind(t, kind)] for kind in ("charge", "voltage"))
    bound = len(charges) == len(volts) == 1 and not charges[0].signed and not volts[0].signed and charges[0].value > 0 and volts[0].value > 0
    if not bound or have & OTHER_WORK or not unit_in(unit, WORK_UNITS) or not formulas(cited) & WORK_RULES:
        return REVIEW
    return compared(number(claim), charges[0].value * volts[0].value)


def lens_rules(cited: list[str] | None) -> list[list[str]]:
    """The cited sentences that say what P equals, as words and marks."""
    parts = [s for text in (() if cited is None else cited) for line in (text or "").splitlines() for s in sentences_of_line(line)]
    return [s for s in parts if any(a == "P" and b == "=" for a, b in zip(s, s[1:]))]


def sentences_of_line(line: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in read(line):
        if t.text in (".", ";"):
            out.append([])
        else:
            out[-1].append(t.text)
    return [s for s in out if s]


def is_lens_rule(said: list[str]) -> bool:
    """P = 1 / f, perhaps after "Lens power", perhaps with "when focal length f is in metres"."""
    said = said[2:] if said[:2] == ["Lens", "power"] else said
    return said[:5] == ["P", "=", "1", "/", "f"] and (said[5:] in ([], *("when focal length f is in".split() + [m] for m in ("metres", "meters"))))


def check_lens(question: str | None, claim: str | None, unit: str | None, cited: list[str] | None) -> str:
    t = read(question)
    have = words(t)
    if not {"lens", "power"} <= have:
        return NOT_ASSESSED
    rules = lens_rules(cited)
    doubted = any(words(read(text)) & DOUBTED for text in (() if cited is None else cited))
    lengths = []
    for i in range(len(t) - 2):
        if follows(t, i, "focal", "length"):
            at = i + 2 + (t[i + 2].low in ("of", "is"))
            if at < len(t) and t[at].of == "length":
                lengths.append(t[at].value)
    bound = rules and all(map(is_lens_rule, rules)) and not doubted and not have & OTHER_LENS and len(lengths) == 1 and lengths[0] != 0
    above, slash, below = (claim or "").partition("/")
    top, bottom = number(above), number(below) if slash else Fraction(1)
    if not bound or not unit_in(unit, POWER_UNITS) or top is None or not bottom:
        return REVIEW
    return compared(top / bottom, 1 / lengths[0])


def asked_current(tokens: list[Token]) -> int | None:
    """Where a question begins to ask for a current; None if it doesn't."""
    start = next((i for i, t in enumerate(tokens) if t.low in ASKING), None)
    return start if start is not None and any(t.low == "current" for t in tokens[start + 1 :]) else None


def unsteady(tokens: list[Token]) -> bool:
    """Whether a text says that something changes: a heated device, a resistance or temperature that varies."""
    if words(tokens) & UNSTEADY:
        return True
    return any(t.low in ("resistance", "temperature") and words(s[i + 1 : i + 9]) & VARYING for s in sentences(tokens) for i, t in enumerate(s))


def said_steady(sentence: list[Token]) -> bool:
    """Whether a sentence calls the resistance constant."""
    low = [t.low for t in sentence]
    for i, word in enumerate(low):
        if word == "resistance":
            rest = low[i + 1 :]
            rest = rest[3:] if rest[:4] == ["is", "assumed", "to", "be"] else rest[1:] if rest[:1] and rest[0] in STAYING else None
            if rest is not None:
                rest = [w for w in rest[:3] if w not in ("be", "the")]
            if rest and rest[0] in STEADY or i and low[i - 1] in ("constant", "unchanged"):
                return True
    return False


def check_condition(question: str | None, cited: list[str] | None) -> str:
    t = read(question)
    volts, currents = of_kind(t, "voltage"), of_kind(t, "current")
    if not words(t) & DEVICES or asked_current(t) is None or len(volts) < 2:
        return NOT_ASSESSED
    if len(volts) != 2 or len(currents) != 1 or not mentioned(cited, OHMS_LAW) or unsteady(t):
        return REVIEW
    steady = [s for s in sentences(t) if said_steady(s)]
    wondered = any(s[-1].text == "?" and any(x.low in WONDERING and "resistance" in words(s[i:]) for i, x in enumerate(s)) for s in sentences(t))
    return REVIEW if steady and wondered else "CONDITION_STATED" if steady else "CONDITION_REQUIRED"


def drawn(tokens: list[Token], at: int) -> bool:
    """Whether the current at a place is what a device draws."""
    at -= 3 if follows(tokens, at - 3, "a", "current", "of") else 0
    return at > 0 and tokens[at - 1].low == "draws"


def operating_point(tokens: list[Token]) -> tuple[Fraction, Fraction] | None:
    """The one voltage and current of a device that a text states: "V when it draws A", or "draws A at V"."""
    found = []
    volts, currents = of_kind(tokens, "voltage"), of_kind(tokens, "current")
    for c in currents:
        if not drawn(tokens, c):
            continue
        for v in volts:
            if v == c + 2 and tokens[c + 1].low == "at":
                found.append((v, c))
            elif v < c:
                between = [t.low for t in tokens[v + 1 : c]]
                subject = between[1:-1] if between[-1:] == ["draws"] else between[1:-4] if between[-4:] == ["draws", "a", "current", "of"] else []
                if between[:1] == ["when"] and (subject == ["it"] or len(subject) == 2 and subject[0] == "the" and subject[1] in DEVICES):
                    found.append((v, c))
    return (tokens[found[0][0]].value, tokens[found[0][1]].value) if len(found) == 1 else None


def check_heater(question: str | None, claim: str | None, unit: str | None, cited: list[str] | None) -> str:
    condition = check_condition(question, cited)
    if condition in (NOT_ASSESSED, REVIEW):
        return condition
    t = read(question)
    asked = asked_current(t)
    point = operating_point(t[:asked])
    targets = [t[i].value for i in of_kind(t, "voltage") if i > asked and t[i - 1].low in ("at", "to")]
    amount = number(claim)
    factor = SYMBOLS.get((unit or "").strip()) or UNIT_NAMES.get((unit or "").strip().lower())
    bound = point and len(targets) == 1 and min(*point, targets[0]) > 0 and not words(t) & OTHER_DEVICE and formulas(cited) & OHMS_LAW
    if not bound or amount is None or not factor or factor[0] != "current":
        return REVIEW
    return compared(amount * Fraction(factor[1]), point[1] * targets[0] / point[0])


def stated_resistances(statement: str | None) -> list[Fraction]:
    """The resistances that sentences state plainly, one each."""
    out = []
    for s in sentences(read(statement)):
        named = [i for i, t in enumerate(s) if t.low == "resistance"]
        found = [i for i in of_kind(s, "resistance") if any(0 < i - n <= NEAR for n in named)]
        if len(found) == 1 and not words(s) & HEDGED:
            out.append(s[found[0]].value)
    return out


def check_resistance(question: str | None, statements: list[str] | None, cited: list[str] | None) -> str:
    t = read(question)
    point = operating_point(t)
    stated = [r for s in (() if statements is None else statements) for r in stated_resistances(s)]
    if question is None or not stated or not point or point[1] == 0 or not mentioned(cited, {"R=V/I", "V=IR"}) or unsteady(t):
        return NOT_ASSESSED
    return "CONSISTENT_WITHIN_SCOPE" if all(r * point[1] == point[0] for r in stated) else CONTRADICTION


def _check(function: Callable, *columns: Column) -> Column:
    return F.udf(function, "string", useArrow=True)(*columns)


def work_mapping(question: Column, claim: Column, unit: Column, cited: Column) -> Column:
    """Work as charge times potential difference."""
    return _check(check_work, question, claim, unit, cited)


def lens_mapping(question: Column, claim: Column, unit: Column, cited: Column) -> Column:
    """Power of one lens as the reciprocal of its focal length in metres; the claim may be a fraction."""
    return _check(check_lens, question, claim, unit, cited)


def resistance_condition(question: Column, cited: Column) -> Column:
    """Whether a question of one device at two voltages states that its resistance stays the same."""
    return _check(check_condition, question, cited)


def heater_mapping(question: Column, claim: Column, unit: Column, cited: Column) -> Column:
    """The current of a device at another voltage, given that its resistance stays the same."""
    return _check(check_heater, question, claim, unit, cited)


def resistance_consistency(question: Column, statements: Column, cited: Column) -> Column:
    """Whether every resistance stated agrees with the question's voltage and current."""
    return _check(check_resistance, question, statements, cited)


#: What stands between a name and its meaning, and words and marks that qualify.
DEFINES, CALLED = ("is defined as", "means", "refers to"), ("is called", "are called", "is defined as", "are defined as")
QUALIFIED, QUOTED = ("not", "never", "if", "unless", "may", "might", "could", "would"), "?\"“”"


def definition_witness(name: Column, text: Column) -> Column:
    """Whether a text says in so many words what a name means, without qualification."""
    plain = F.trim(squeeze(F.lower(text)), F.lit(" .;"))
    spaced = F.concat(F.lit(" "), F.regexp_replace(plain, r"[^\p{L}\p{N}_'-]+", " "), F.lit(" "))
    term = term_pattern(name)
    defined = F.rlike(plain, F.concat(F.lit(r"(?<!\w)"), term, F.lit(" (?:" + "|".join(DEFINES) + ") .")))
    called = F.lit(False)
    for said in CALLED:
        before, after = F.substring_index(plain, f" {said} ", 1), F.substring_index(plain, f" {said} ", -1)
        called = called | (before != plain) & (before != "") & F.rlike(after, F.concat(F.lit("^"), term, F.lit("$")))
    qualified = F.exists(F.array(*(F.lit(f" {w} ") for w in QUALIFIED)), lambda w: F.contains(spaced, w)) | (F.translate(plain, QUOTED, "") != plain)
    return F.coalesce((defined | called) & ~qualified, F.lit(False))
