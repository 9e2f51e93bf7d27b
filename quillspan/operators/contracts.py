"""Contracts of answers, witnesses and reviews, as columns over what was said and what was shown.

Arrays may be null, which counts as empty; an absent status or basis is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.algebra import let

#: Statuses of an answer, and what a witness may rest on.
STATUSES = ("PASS", "FAIL_GAP", "FAIL_LOGIC", "ABSTAIN")
STATED, INSUFFICIENT = ("STATED", "DERIVED"), "INSUFFICIENT"
RESPONSE = "status string, citations array<string>, missing array<string>"


def _or_empty(items: Column, kind: str = "string") -> Column:
    return F.coalesce(items, F.array().cast(f"array<{kind}>"))


def _filled(text: Column) -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit(""))) != ""


def issues(**tests: Column) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items())))


def answer_issues(status: Column, value: Column, unit: Column, citations: Column, shown: Column, direct: bool = False) -> Column:
    """What an answer breaks: its status, an answer without a pass, a pass without one, a value without a unit, citations that it lacks (unless it is a direct answer, which has none) or that weren't shown."""
    passed, cited = status == "PASS", _or_empty(citations)
    return issues(
        unknown_status=~F.coalesce(status.isin(*STATUSES), F.lit(False)),
        answer_without_pass=~passed & (_filled(value) | _filled(unit)),
        pass_without_answer=passed & ~_filled(value) & ~_filled(unit),
        value_without_unit=_filled(value) != _filled(unit),
        no_citation=F.lit(not direct) & passed & (F.size(cited) == 0),
        cites_directly=F.lit(direct) & (F.size(cited) > 0),
        unknown_citation=F.size(F.array_except(cited, _or_empty(shown))) > 0,
    )


def in_bounds(citations: Column, shown: Column) -> Column:
    """How many distinct citations were shown."""
    return F.size(F.array_intersect(_or_empty(citations), _or_empty(shown)))


def witness_decision(basis: Column, evidence_id: Column, quote: Column, catalog: Column) -> Column:
    """SUPPORTED if what is said to state a requirement is there: a known passage (of structs id, text) that has the quote word for word; else INVALID_EVIDENCE, UNRESOLVED for an insufficient witness, ERROR for none."""
    cited = F.filter(catalog, lambda p: p["id"] == evidence_id)
    held = F.exists(cited, lambda p: F.contains(p["text"], quote)) & (F.coalesce(quote, F.lit("")) != "")
    known = F.when(F.coalesce(held, F.lit(False)), "SUPPORTED").otherwise("INVALID_EVIDENCE")
    return F.when(basis.isin(*STATED), known).when(basis == INSUFFICIENT, "UNRESOLVED").otherwise("ERROR")


def curriculum_status(requirements: Column, objects: Column, grounded: Column) -> Column:
    """MODEL_SUPPORTED if every requirement is (there is one at least), the review is grounded and doesn't object; ERROR if one ended so."""
    fine = (F.size(requirements) > 0) & F.forall(requirements, lambda r: r == "SUPPORTED") & ~objects & grounded
    return F.when(F.exists(_or_empty(requirements), lambda r: r == "ERROR"), "ERROR").when(F.coalesce(fine, F.lit(False)), "MODEL_SUPPORTED").otherwise("REVIEW_REQUIRED")


def review_problem(read: Column, context: Column, judgments: Column, objects: Column, kind: str = "string") -> Column:
    """Why a review can't be used (null: it can): it read what isn't the context, or not all of it, or objects though all its judgments hold, or the other way round."""
    own, every = _or_empty(read, kind), _or_empty(context, kind)
    fails = F.exists(_or_empty(judgments, "boolean"), lambda j: ~F.coalesce(j, F.lit(False)))
    return F.when(F.size(F.array_except(own, every)) > 0, "unknown_context").when(F.size(F.array_except(every, own)) > 0, "context_not_read").when(fails != objects, "judgments_disagree")


def guard_gap(status: Column, complete: Column) -> Column:
    """A gap can only be found in a context that is complete: else FAIL_GAP is ABSTAIN, and CONTROLLED_GAP is UNCERTAIN."""
    return F.when(F.coalesce(complete, F.lit(False)), status).when(status == "FAIL_GAP", "ABSTAIN").when(status == "CONTROLLED_GAP", "UNCERTAIN").otherwise(status)


def verdict_of(content: Column, earlier: Column, complete: Column) -> Column:
    """The verdict in a model's JSON: ERROR if it can't be read, has another status or cites what isn't among the earlier passages; a gap is guarded."""

    def judged(said: Column) -> Column:
        fine = said["status"].isin(*STATUSES) & said["citations"].isNotNull() & said["missing"].isNotNull() & (F.size(F.array_except(said["citations"], _or_empty(earlier))) == 0)
        return F.when(F.coalesce(fine, F.lit(False)), guard_gap(said["status"], complete)).otherwise("ERROR")

    # read once, not once for each of its fields
    return let(F.from_json(content, RESPONSE), judged)


def decision(claimed: Column, computed: Column, missing: Column, conflict: Column, complete: Column) -> Column:
    """A verdict from what was found: conflicts and what can't be computed abstain, a missing definition is a gap if the context is complete, else the values decide."""
    gap = guard_gap(F.lit("FAIL_GAP"), complete)
    return F.when(F.coalesce(conflict, F.lit(False)), "ABSTAIN").when(F.coalesce(missing, F.lit(False)), gap).when(claimed.isNull() | computed.isNull(), "ABSTAIN").when(claimed == computed, "PASS").otherwise("FAIL_LOGIC")
