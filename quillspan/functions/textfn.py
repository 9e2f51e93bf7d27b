"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function names looked for in formulas, and where subjects are recognised by their words.
FUNCTIONS = (
    "sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "coth",
    "log", "ln", "exp", "sqrt", "lim", "sum", "prod", "int",
)
DOMAINS = {"calculus": ("derivative", "integral", "limit"), "algebra": ("equation", "polynomial", "matrix"), "geometry": ("triangle", "circle", "angle"), "statistics": ("mean", "variance", "probability")}


def normal_name(name: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def normal_text(text: Column) -> Column:
    """normal_name() without blanks, periods and semicolons at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"^[ .;]+|[ .;]+$", "")


def digest_id(*parts: Column, size: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts in lower case, joined by colons."""
    return F.substring(F.sha2(F.lower(F.concat_ws(":", *parts)).cast("binary"), 256), 1, size)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def balanced(text: Column) -> Column:
    """Closers appended, or openers put in front, until both are as many, for each kind of bracket."""
    for opener, closer in ("{}", "()", "[]"):
        more = occurrences(text, opener) - occurrences(text, closer)
        text = F.concat(F.repeat(F.lit(opener), F.greatest(F.lit(0), -more)), text, F.repeat(F.lit(closer), F.greatest(F.lit(0), more)))
    return text


def chunks(text: Column, size: int, separator: str = "\n\n") -> Column:
    """Paragraphs joined while their total stays below ``size`` (each counts its separator); a fold over the paragraphs."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(p) < size
        grown = F.struct(F.concat(acc["cur"], p, F.lit(separator)).alias("cur"), acc["done"].alias("done"))
        done = F.when(F.trim(acc["cur"]) != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
        return F.when(fits, grown).otherwise(F.struct(F.concat(p, F.lit(separator)).alias("cur"), done.alias("done")))

    end = lambda acc: F.when(F.trim(acc["cur"]) != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])
    return F.aggregate(F.split(text, separator), start, step, end)


def variables(latex: Column) -> Column:
    """Single letters outside commands, without those that stand for constants, sorted."""
    bare = F.regexp_replace(latex, r"\\[a-zA-Z]+", " ")
    letters = F.regexp_extract_all(bare, F.lit(r"(?<![a-zA-Z])[a-zA-Z](?![a-zA-Z])"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(letters), F.array(*map(F.lit, "dDeEiI"))))


def used_functions(latex: Column, names: tuple[str, ...] = FUNCTIONS) -> Column:
    return F.filter(F.array(*map(F.lit, names)), lambda f: latex.contains(F.concat(F.lit("\\"), f)))


def domain_hints(text: Column, domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    def has(words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.lower(text).contains(w)
        return found

    return F.array_compact(F.array(*(F.when(has(words), F.lit(name)) for name, words in domains.items())))


def slug(text: Column, size: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9_]", "_"), 1, size)


def fence(text: Column) -> Column:
    """A fence of backticks longer than any run of them in the text, at least three."""
    runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def depth(text: Column, opener: str = "{", closer: str = "}") -> Column:
    """The deepest nesting of a kind of bracket; surplus closers count down below zero."""
    marks = F.regexp_extract_all(text, F.lit(f"[{'' if opener.isalnum() else chr(92)}{opener}{'' if closer.isalnum() else chr(92)}{closer}]"), F.lit(0))
    step = lambda acc, m: F.struct((acc["now"] + F.when(m == opener, 1).otherwise(-1)).alias("now"), F.greatest(acc["top"], acc["now"] + F.when(m == opener, 1).otherwise(-1)).alias("top"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])


def only(found: Column) -> Column:
    """The element of an array of one; null otherwise."""
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


#: A literal is digits with an optional fraction; it is compared without leading zeros and zeros at a fraction's end.
LITERAL = r"[0-9]+(?:\.[0-9]+)?"


def literals(text: Column) -> Column:
    """The distinct numbers of a text in canonical form."""
    canonical = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), "^0+([0-9])", "$1")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)), canonical))
