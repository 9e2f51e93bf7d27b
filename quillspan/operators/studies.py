"""Studies: every case under every model, prompt and arm, called once, judged, and summarised with all that was planned in the denominator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import verdict_of
from .external import Completion, call_rows
from .rounds import Rounds
from .stats import share, wilson

PLAN = ("model", "prompt", "arm")


def run_study(cases: DataFrame, models: list[str], prompts: list[str], arms: dict[str, str], completion: Completion, rounds: Rounds | None = None) -> DataFrame:
    """A row for each case, model, prompt and arm: case_id, PLAN, expected, verdict (ERROR for calls that failed and answers that break the contract; a gap is guarded) and exact (it is what is expected).

    cases: case_id (one case each), question, expected, complete, and an array of structs
    (id, text) for each arm, named by ``arms``: what that arm shows.  The lists are short.

    Cases are dealt out evenly, and all that is planned for one is called where it lies,
    from one reading of it.  Answers are written, a row a case, before they are judged, so
    a run that starts again on the same folder repeats none; nothing is joined.
    """
    rounds = rounds or Rounds(cases.sparkSession, "study")
    planned = [(m, p, a) for m in models for p in prompts for a in arms]

    def requests_of(case: dict) -> list[dict]:
        one = {"case_id": case.get("case_id"), "question": case.get("question")}
        return [{**one, "model": m, "prompt": p, "arm": a, "passages": case["shown"].get(a) or []} for m, p, a in planned]

    dealt = cases.repartition(4 * cases.sparkSession.sparkContext.defaultParallelism)
    request = F.to_json(F.struct("case_id", "question", F.struct(*(F.col(c).alias(a) for a, c in arms.items())).alias("shown")))
    ids = F.struct(*(F.transform(c, lambda p: p["id"]).alias(a) for a, c in arms.items()))
    asked = dealt.select("case_id", "expected", "complete", ids.alias("ids"), request.alias("request"))
    called = rounds.keep("calls", lambda: call_rows(asked, requests_of, completion))
    row = lambda i, m, p, a: F.struct(F.lit(m).alias("model"), F.lit(p).alias("prompt"), F.lit(a).alias("arm"), F.col("ids")[a].alias("shown"), F.get("outcomes", F.lit(i))["response"].alias("response"))
    answered = called.select("case_id", "expected", "complete", F.inline(F.array(*(row(i, *x) for i, x in enumerate(planned)))))
    judged = answered.withColumn("verdict", verdict_of(F.col("response"), F.col("shown"), F.col("complete")))
    return judged.select("case_id", *PLAN, "expected", "verdict", (F.col("verdict") == F.col("expected")).alias("exact"))


def summary(results: DataFrame) -> DataFrame:
    """Per model, prompt and arm: planned rows, errors, exact ones, their share and its interval."""
    exact, n = F.count_if("exact"), F.count(F.lit(1))
    found = results.groupBy(*PLAN).agg(n.alias("planned"), F.count_if(F.col("verdict") == "ERROR").alias("errors"), exact.alias("exact"))
    return found.withColumns({"rate": share(F.col("exact"), F.col("planned")), "low": wilson(F.col("exact"), F.col("planned"), False), "high": wilson(F.col("exact"), F.col("planned"), True)})
