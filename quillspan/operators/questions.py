"""The audit of numerical questions: one status for each, from the first guard that objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import algebra, quantities
from ..functions.textfn import literals
from .cascade import Stage, decide
from .rounds import Rounds
from .select import top_k

#: Wordings by which a question hangs on something drawn.
DRAWN = r"(?i)\bfig(?:ure)?\.?\s*[0-9]|\b(?:diagram|figure|graph|circuit)\s+(?:is\s+)?(?:shown|below|above)|\b(?:shown|given)\s+in\s+(?:the\s+|a\s+)?(?:diagram|figure|graph)"
CONTEXT = 4


def audit_questions(questions: DataFrame, passages: DataFrame, judgments: DataFrame, most: int = CONTEXT, rounds: Rounds | None = None) -> DataFrame:
    """questions with status and guard.

    questions: id, question, background, source, before, region (null or what stands for
    it); passages: source, position, id, text; judgments: id, verdict, cited (ids),
    missing (ids), expression, claimed, unit, statements (texts).

    A question may see the ``most`` passages of its source that are nearest before it.
    The guards, in order: what can't be asked in text; no evidence; a judgment that isn't
    there, cites what wasn't shown or answers without passing; one that passes without
    evidence or answer; a calculation that doesn't give what is claimed; quantities,
    numbers and assumptions against the question and the cited text.
    """
    texts = passages.withColumnRenamed("id", "passage")

    def evidence(open_rows: DataFrame) -> DataFrame:
        seen = open_rows.select("id", "source", "before").join(texts, "source").where("position < before")
        near = top_k(seen, ["id"], [F.desc("position"), F.col("passage")], most, "nth")
        shown = near.groupBy("id").agg(F.collect_list(F.struct("passage", "text")).alias("context"))  # of `most` passages
        return open_rows.join(shown, "id", "left")

    def answers(open_rows: DataFrame) -> DataFrame:
        return open_rows.join(judgments, "id", "left")

    def cited_texts(open_rows: DataFrame) -> DataFrame:
        own = F.transform(F.filter("context", lambda c: F.array_contains("cited", c["passage"])), lambda c: c["text"])
        return open_rows.withColumn("texts", own)

    c = F.col
    blank = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) == ""
    said = lambda test, status: F.when(F.coalesce(test, F.lit(False)), F.lit(status))
    passes = c("verdict") == "PASS"
    some = lambda name: F.size(F.coalesce(c(name), F.array().cast("array<string>"))) > 0
    outside = F.size(F.array_except("cited", F.transform("context", lambda x: x["passage"]))) > 0
    agrees = algebra.equivalence(algebra.postfix(algebra.plain(c("expression"))), algebra.postfix(algebra.plain(c("claimed")))) == "EQUIVALENT"
    mapped = lambda f: F.when(f.isin("CONTRADICTION", "REVIEW_REQUIRED"), "QUANTITY_REVIEW_REQUIRED")
    given = F.array_union(literals(F.concat_ws(" ", "question", "background")), literals(F.array_join("texts", " ")))
    work = quantities.work_mapping(c("question"), c("claimed"), c("unit"), c("texts"))
    lens = quantities.lens_mapping(c("question"), c("claimed"), c("unit"), c("texts"))
    heater = quantities.heater_mapping(c("question"), c("claimed"), c("unit"), c("texts"))
    condition = quantities.resistance_condition(c("question"), c("texts"))

    def checks(open_rows: DataFrame) -> DataFrame:
        """The checks that read whole sentences, once for each row that came so far."""
        return cited_texts(open_rows).withColumns({"work": work, "lens": lens, "heater": heater, "condition": condition, "holds": quantities.resistance_consistency(c("question"), c("statements"), c("texts"))})

    stages = [
        Stage("input", (("region", said(c("region").isNotNull(), "INPUT_REVIEW_REQUIRED")), ("figure", said(c("question").rlike(DRAWN), "INPUT_REVIEW_REQUIRED")))),
        Stage("evidence", (("no_evidence", said(c("context").isNull(), "ERROR")),), evidence),
        Stage(
            "judgment",
            (
                ("no_judgment", said(c("verdict").isNull(), "ERROR")),
                ("citation", said(outside, "ERROR")),
                ("conflicting_answer", said(~passes & ~(blank("expression") & blank("claimed") & blank("unit")), "ERROR")),
                ("verdict", F.when(~passes, c("verdict"))),
                ("no_citation", said(some("missing") | ~some("cited"), "ABSTAIN")),
                ("no_answer", said(blank("expression") | blank("claimed") | blank("unit"), "ABSTAIN")),
            ),
            answers,
        ),
        Stage("calculation", (("calculation", said(~agrees, "REJECTED_CALCULATION")),)),
        Stage(
            "quantities",
            (
                ("work", mapped(c("work"))),
                ("lens", mapped(c("lens"))),
                ("numbers", said(F.size(F.array_except(literals(c("expression")), given)) > 0, "SOURCE_REVIEW_REQUIRED")),
                ("resistance", said(c("holds") == "CONTRADICTION", "REJECTED_ASSUMPTION")),
                ("condition", said(c("condition") == "REVIEW_REQUIRED", "ASSUMPTION_REVIEW_REQUIRED")),
                ("heater", mapped(c("heater"))),
            ),
            checks,
        ),
    ]
    return decide(questions, stages, F.when(c("condition") == "CONDITION_REQUIRED", "CONDITIONAL_ANSWER").otherwise("ARITHMETIC_CHECKED"), rounds)
