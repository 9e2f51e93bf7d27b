"""The evidence audit: requirements of a task, passages before it, witnessed support, and a status.

Requirements that several routes share are asked about once.  A witness counts only if
the passage it cites was shown and holds the quote word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import external, retrieval, select
from .corpus import eligible_records

WITNESS = "basis string, evidence_id string, quote string"


def route_status(requirement_status: Column) -> Column:
    """SUPPORTED only if every requirement is (an aggregate)."""
    return F.when(F.every(requirement_status == "SUPPORTED"), "MODEL_SUPPORTED").when(F.some(requirement_status == "ERROR"), "ERROR").otherwise("REVIEW_REQUIRED")


def audit(records: DataFrame, targets: DataFrame, requirements: DataFrame, path: str, completion: external.Completion = external.offline_completion, top: int = 3, budget: int = 4000) -> dict[str, DataFrame]:
    """Tables of an audit: passages, witnesses, requirements and targets.

    targets: target_id, target_source, target_position; requirements: target_id,
    requirement_id, requirement.  Targets and requirements without any passage keep
    their rows.  Calls go through ``external.call_all`` and are stored at ``path``.
    """
    eligible = eligible_records(records, targets).select("target_id", "id", "position", "content")
    key = F.concat_ws("/", "target_id", "requirement_id")
    asked = requirements.select(key.alias("key"), "target_id", "requirement_id", "requirement")
    # a target's passages are indexed once; their contents are joined to the few that are kept
    questions = asked.select("target_id", "key", F.col("requirement").alias("question"))
    scores = retrieval.tf_idf(eligible.select("target_id", "id", "content"), questions, "target_id", "id", query="key")
    ranked = scores.join(eligible.select("target_id", "id", "position"), ["target_id", "id"])
    few = select.top_k(ranked.withColumn("r9", F.round("score", 9)), ["key"], [F.desc("r9"), F.col("position")], top).where("score > 0")
    best = few.join(eligible.select("target_id", "id", "content"), ["target_id", "id"])
    passages = select.first_fit(best.withColumn("size", F.length("content")), ["key"], "rank", "size", budget).select("key", "id", "rank", "score", "content")
    shown = passages.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "content"))).alias("shown"))
    requests = asked.join(shown, "key").select("key", F.to_json(F.struct("requirement", F.transform("shown", lambda p: F.struct(p["id"].alias("id"), p["content"].alias("content"))).alias("passages"))).alias("request"))
    answers = external.call_all(requests, path, completion).withColumn("w", F.from_json("response", WITNESS))
    cited = F.filter("shown", lambda p: p["id"] == F.col("w.evidence_id"))
    held = F.coalesce(F.exists(cited, lambda p: F.contains(F.lower(p["content"]), F.lower(F.col("w.quote"))) & (F.col("w.quote") != "")), F.lit(False))
    status = F.when(F.col("status") == "ERROR", "ERROR").when(F.col("w.basis").isin("STATED", "DERIVED") & held, "SUPPORTED").otherwise("UNRESOLVED")
    witnesses = answers.join(shown, "key").select("key", "w.basis", "w.evidence_id", "w.quote", "attempts", status.alias("requirement_status"))
    judged = asked.join(witnesses.select("key", "requirement_status"), "key", "left").withColumn("requirement_status", F.coalesce("requirement_status", F.lit("UNRESOLVED")))
    results = targets.select("target_id").join(judged.groupBy("target_id").agg(route_status(F.col("requirement_status")).alias("status")), "target_id", "left")
    return {"passages": passages.drop("content"), "witnesses": witnesses, "requirements": judged, "targets": results.withColumn("status", F.coalesce("status", F.lit("INPUT_REVIEW_REQUIRED")))}
