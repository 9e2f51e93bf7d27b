"""Source-order scope: what a target may see lies in its own source, before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cues of rules and of figures.
RULE_CUE = r"\b(?:is|are|we)\s+(?:defined|called|given by|equal to)\b|\bproportional\b|="
FIGURE_CUE = r"(?i)\b(?:fig(?:ure)?\.?\s*\d|shown (?:in|below|above)|diagram)"


def in_scope(source: Column, start: Column, end: Column, target_source: Column, before: Column) -> Column:
    """A span of the same source with 0 <= start < end <= before; null offsets are out of scope."""
    return F.coalesce((source == target_source) & (start >= 0) & (start < end) & (end <= before), F.lit(False))


def is_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def heads_example(words: Column) -> Column:
    """Whether a line, as its words, opens a worked example (the word and a number) or a solution; marks after them don't matter."""
    plain = lambda n: F.regexp_replace(F.lower(F.coalesce(F.get(words, F.lit(n)), F.lit(""))), r"[^\p{L}\p{N}_]+$", "")
    numbered = plain(1).rlike(r"^\d")
    return (plain(0) == "solution") | ((plain(0) == "example") & numbered)


def is_worked_example(text: Column) -> Column:
    """Whether some line of a text opens a worked example or a solution."""
    lines = F.split(F.coalesce(text, F.lit("")), r"[\n\r\f]")
    return F.exists(lines, lambda line: heads_example(F.split(F.trim(squeeze(line)), " ")))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def states_rule(text: Column) -> Column:
    """A rule-like cue in a text that isn't a worked example."""
    return ~is_worked_example(text) & F.lower(squeeze(text)).rlike(RULE_CUE)


def violation(source: Column, position: Column, target_source: Column, target_position: Column) -> Column:
    """Why a record may not be cited for a target; null if it may."""
    return F.when(~source.eqNullSafe(target_source), "different_source").when(position >= target_position, "target_or_later_material")
