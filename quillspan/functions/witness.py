"""Statements of a text about named things, read clause by clause as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scope import squeeze

#: Relations and the words that state them.
STATES = {
    "MEASURES": ("measures", "is used to measure"),
    "FLOWS_THROUGH": ("flows through",),
    "CONTROLS": ("controls",),
    "EXPRESSES": ("expresses", "represents"),
    "USES_QUANTITY": ("uses", "uses the quantity"),
    "DERIVED_FROM": ("is derived from",),
}
#: Words and marks by which a text doesn't state what it says.
DOUBTS = ("not", "no", "never", "may", "might", "could", "would", "should", "if", "unless", "assuming", "suppose", "only")
MARKS = '?"“”'
ARTICLES = ("the", "an", "a")


def words(text: Column) -> Column:
    """The words of a text in lower case, between white space."""
    return F.filter(F.split(squeeze(F.lower(text)), " "), lambda w: w != "")


def bare(tokens: Column) -> Column:
    """Words without an article before them."""
    return F.when(F.get(tokens, F.lit(0)).isin(*ARTICLES), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def name_words(name: Column) -> Column:
    """The words of a name, without its article and without a symbol of one or two letters in parentheses."""
    symbol = lambda w: w.startswith("(") & w.endswith(")") & F.length(w).between(3, 4)
    return bare(F.filter(words(name), lambda w: ~symbol(w)))


def term_pattern(name: Column) -> Column:
    """A pattern for a name as it may be printed, with or without an article; one that nothing fits for a name without words."""
    tokens = F.array_join(F.transform(name_words(name), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), " ")
    return F.when(F.coalesce(F.size(name_words(name)), F.lit(0)) <= 0, "(?!)").otherwise(F.concat(F.lit(f"(?:(?:{'|'.join(ARTICLES)}) )?"), tokens))


def relation_witness(kind: Column, subject: Column, other: Column, text: Column) -> Column:
    """The first clause of a text that states the relation between the two names, in that direction and in so many words; null if there is none.

    Clauses end at full stops and semicolons.  A clause has to be the first name, the
    relation's words and the second name, with articles or without.  A text with a word
    or mark of doubt anywhere states nothing.
    """
    clean = lambda c: F.filter(words(c), lambda w: w != "")
    doubted = F.arrays_overlap(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), F.array(*map(F.lit, DOUBTS))) | (F.translate(text, MARKS, "") != text)
    stated = F.create_map(*(x for k, forms in STATES.items() for x in (F.lit(k), F.array(*map(F.lit, forms)))))[kind]
    first, second = F.array_join(name_words(subject), " "), F.array_join(name_words(other), " ")
    lead = F.array(*map(F.lit, ("", *(f"{a} " for a in ARTICLES))))
    fits = F.flatten(F.transform(stated, lambda said: F.transform(lead, lambda article: F.concat(first, F.lit(" "), said, F.lit(" "), article, second))))
    clauses = F.filter(F.transform(F.split(text, "[.;]"), lambda c: F.array_join(clean(c), " ")), lambda c: c != "")
    found = F.get(F.filter(clauses, lambda c: F.array_contains(fits, F.array_join(bare(F.split(c, " ")), " "))), F.lit(0))
    return F.when(~doubted & (first != "") & (second != ""), found)
