"""LaTeX text: a normal form with the steps that changed something, bracket checks, and plain or prover text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import let
from .textfn import balanced

#: Rewriting steps in order: name, pattern, replacement.
STEPS = (
    ("strip_delimiters", r"^\s*\$+|\$+\s*$|\\[\[\]]|\\displaystyle(?![a-zA-Z])", ""),
    ("strip_environments", r"\\(?:begin|end)\{[a-zA-Z]+\*?\}", ""),
    ("drop_sizes", r"\\(?:left|right|big|Big)(?![a-zA-Z])", ""),
    ("drop_spacing", r"\\[,;:!]|\\q?quad(?![a-zA-Z])", " "),
    ("unwrap_text", r"\\(?:text|mathrm|mathit)\{([^{}]*)\}", "$1"),
    ("unify_fractions", r"\\[dt]frac(?![a-zA-Z])", r"\\frac"),
    ("unify_operators", r"\\(?:times|cdot)(?![a-zA-Z])", "*"),
    ("brace_fractions", r"\\frac\s*([0-9a-zA-Z])\s*([0-9a-zA-Z])", r"\\frac{$1}{$2}"),
    ("brace_subscripts", r"_([0-9a-zA-Z])(?![0-9a-zA-Z])", "_{$1}"),
    ("brace_superscripts", r"\^([0-9a-zA-Z])(?![0-9a-zA-Z])", "^{$1}"),
    ("balance", "", ""),
    ("collapse_space", r"\s+", " "),
)
#: Commands that are known, endings of further ones, and how long a command may be that isn't.
COMMANDS = (
    "frac", "dfrac", "tfrac", "sqrt", "root",
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega",
    "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Upsilon", "Phi", "Psi", "Omega",
    "sum", "prod", "int", "iint", "iiint", "oint", "lim", "log", "ln", "exp", "sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "coth",
    "leq", "geq", "neq", "approx", "equiv", "sim", "subset", "supset", "subseteq", "supseteq", "in", "notin", "ni",
    "to", "rightarrow", "leftarrow", "leftrightarrow", "Rightarrow", "Leftarrow", "Leftrightarrow", "mapsto",
    "hat", "bar", "vec", "dot", "ddot", "tilde", "overline", "underline", "overbrace", "underbrace",
    "quad", "qquad", "text", "mathrm", "mathbf", "mathit", "mathcal", "mathbb", "mathfrak",
    "left", "right", "big", "Big", "bigg", "Bigg", "begin", "end", "matrix", "pmatrix", "bmatrix", "cases",
    "cdot", "times", "div", "pm", "mp", "infty", "partial", "nabla", "forall", "exists", "neg", "land", "lor", "ldots", "cdots", "vdots", "ddots", "prime",
)
ENDINGS, SHORT = ("text", "math", "box", "space", "style", "size"), 2
#: What a reader of images tends to make up: name and pattern.
SUSPICIOUS = (
    ("operators", r"[+\-*/=]{3,}"),
    ("empty_group", r"\{\s*\}"),
    ("scripts", r"[\^_]{2,}"),
    ("digit_command", r"\\[0-9]"),
    ("long_subscript", r"_[a-zA-Z]{4,}(?![}])"),
)
PLAIN = ((r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(($1)/($2))"), (r"\\sqrt\{([^{}]*)\}", r"sqrt($1)"), (r"\^\{([^{}]*)\}", r"^($1)"), (r"\\(sin|cos|tan|log|ln|exp|pi)(?![a-zA-Z])", r"$1"), (r"\s+", " "))
PROVER = ((r"\\leq?(?![a-zA-Z])", "≤"), (r"\\geq?(?![a-zA-Z])", "≥"), (r"\\neq?(?![a-zA-Z])", "≠"), (r"\\in(?![a-zA-Z])", "∈"), (r"\\forall(?![a-zA-Z])", "∀"), (r"\\exists(?![a-zA-Z])", "∃"))


def normalize(latex: Column, steps: tuple = STEPS) -> Column:
    """A struct of the normal form and the names of the steps that changed something, sorted."""
    def step(name: str, pattern: str, by: str):
        def apply(state: Column) -> Column:
            new = balanced(state["latex"]) if name == "balance" else F.regexp_replace(state["latex"], pattern, by)
            note = lambda n: F.when(n != state["latex"], F.array_append(state["applied"], F.lit(name))).otherwise(state["applied"])
            return let(new, lambda n: F.struct(n.alias("latex"), note(n).alias("applied")))

        return apply

    state = F.struct(latex.alias("latex"), F.array().cast("array<string>").alias("applied"))
    for one in steps:
        state = let(state, step(*one))
    return let(state, lambda done: F.struct(F.trim(done["latex"]).alias("latex"), F.array_sort(done["applied"]).alias("applied")))


def rewrite(text: Column, rules: tuple) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def brackets(text: Column) -> Column:
    """A struct of how many brackets close the wrong one, close nothing, and stay open: a stack folded over the brackets."""
    marks = F.regexp_extract_all(text, F.lit(r"[\[\](){}]"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("crossed"), F.lit(0).alias("unopened"))
    opener = F.create_map(*map(F.lit, (")", "(", "]", "[", "}", "{")))

    def step(acc: Column, m: Column) -> Column:
        depth = F.size(acc["open"])
        pushed = F.struct(F.array_append(acc["open"], m).alias("open"), acc["crossed"].alias("crossed"), acc["unopened"].alias("unopened"))
        bad = F.when(F.element_at(acc["open"], -1) == opener[m], 0).otherwise(1)
        popped = F.struct(F.slice(acc["open"], F.lit(1), depth - 1).alias("open"), (acc["crossed"] + bad).alias("crossed"), acc["unopened"].alias("unopened"))
        lost = F.struct(acc["open"].alias("open"), acc["crossed"].alias("crossed"), (acc["unopened"] + 1).alias("unopened"))
        return F.when(m.isin("(", "[", "{"), pushed).when(depth > 0, popped).otherwise(lost)

    return F.aggregate(marks, start, step, lambda acc: F.struct(acc["crossed"].alias("crossed"), acc["unopened"].alias("unopened"), F.size(acc["open"]).alias("unclosed")))


def confidence(errors: Column, warnings: Column) -> Column:
    """1 less a tenth for each error and half of that for each warning, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - 0.1 * (errors + 0.5 * warnings))


def unknown_commands(text: Column) -> Column:
    """The commands of a text that aren't known, in order: not on the list, longer than SHORT, and without one of the ENDINGS."""
    used = F.regexp_extract_all(text, F.lit(r"\\([a-zA-Z]+)"), F.lit(1))
    fine = lambda c: c.isin(*COMMANDS) | (F.length(c) <= SHORT) | c.rlike(f"(?:{'|'.join(ENDINGS)})$")
    return F.filter(used, lambda c: ~fine(c))


def suspicious(text: Column) -> Column:
    """How often each suspicious pattern occurs, as a struct."""
    return F.struct(*(F.regexp_count(text, F.lit(pattern)).alias(name) for name, pattern in SUSPICIOUS))
