"""Questions that are generated, verified and corrected in rounds of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra
from .external import Completion, calls
from .rounds import Rounds, union_all

ATTEMPTS = 3
#: What an answer to a request looks like.
ITEM = "question string, question_latex string, options map<string,string>, correct_answer string, solution_steps array<string>"
STRUCT = "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in ITEM.split(", ")) + ">"


def errors_of(item: Column) -> Column:
    """What is wrong with a generated question: its right option can't be read, options that equal it (numbered without it, by label), no steps."""
    options = F.map_entries(F.coalesce(item["options"], F.expr("map()").cast("map<string,string>")))
    label = F.coalesce(item["correct_answer"], F.lit("A"))
    correct = F.coalesce(F.get(F.transform(F.filter(options, lambda o: o["key"] == label), lambda o: o["value"]), F.lit(0)), F.lit(""))
    others = F.transform(F.array_sort(F.filter(options, lambda o: o["key"] != label)), lambda o: o["value"])
    unread = F.when((F.coalesce(item["question_latex"], F.lit("")) != "") & (algebra.verify_parse(correct) == "invalid"), F.lit("Correct answer parse error"))
    equal = algebra.let(algebra.postfix(algebra.plain(correct)), lambda c: F.transform(others, lambda o, i: F.when(algebra.equivalence(c, algebra.postfix(algebra.plain(o))) == "EQUIVALENT", F.concat(F.lit("Distractor "), (i + 1).cast("string"), F.lit(" is equivalent to correct answer")))))
    steps = F.when(F.size(F.coalesce(item["solution_steps"], F.array().cast("array<string>"))) <= 0, F.lit("Missing solution steps"))
    return F.array_compact(F.concat(F.array(unread), equal, F.array(steps)))


def generate(topics: DataFrame, completion: Completion, attempts: int = ATTEMPTS, rounds: Rounds | None = None) -> DataFrame:
    """topic, item, verified, attempts, confidence and errors of every topic (columns topic, difficulty).

    A round asks for the topics that are open, with the errors of the last round as
    feedback, and verifies what comes back; only failing ones go on.  Calls and verdicts
    of a round are written before the next begins, so a run that starts again on the same
    folder repeats no call.  A verified item has confidence 1; after the last attempt the
    last item is returned unverified, at 0.5 less 0.1 for each attempt and 0 at least,
    with all errors so far; item is null if no attempt gave one.
    """
    rounds = rounds or Rounds(topics.sparkSession, "generation")
    open_topics = topics.select("topic", "difficulty", F.lit("").alias("feedback"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast(STRUCT).alias("last"))
    closed: list[DataFrame] = []
    for attempt in range(1, attempts + 1):
        request = F.to_json(F.struct("topic", "difficulty", "feedback", F.lit(attempt).alias("attempt")))
        asked = open_topics.withColumn("key", F.sha2(request, 256)).withColumn("request", request)
        answered = rounds.keep(f"calls-{attempt}", lambda a=asked: calls(a.select("key", "request"), completion))
        item = F.from_json("response", ITEM)
        back = asked.join(answered.select("key", "response"), "key", "left").withColumn("item", item)
        failed = F.array(F.lit(f"Attempt {attempt}: Generation failed"))
        found = F.when(F.col("item").isNull(), failed).otherwise(errors_of(F.col("item")))
        judged = rounds.keep(f"judged-{attempt}", lambda b=back, f=found: b.select("topic", "difficulty", "feedback", "errors", "last", "item", f.alias("found")))
        good = F.size("found") == 0
        none = F.array().cast("array<string>")
        closed.append(judged.where(good).select("topic", "item", F.lit(True).alias("verified"), F.lit(attempt).alias("attempts"), F.lit(1.0).alias("confidence"), none.alias("errors")))
        feedback = F.when(F.col("item").isNull(), F.col("feedback")).otherwise(F.array_join("found", "\n"))
        open_topics = judged.where(~good).select("topic", "difficulty", feedback.alias("feedback"), F.concat("errors", "found").alias("errors"), F.coalesce("item", "last").alias("last"))
        if open_topics.isEmpty():
            break
    left = open_topics.select("topic", F.col("last").alias("item"), F.lit(False).alias("verified"), F.lit(attempts).alias("attempts"), F.lit(max(0.0, 0.5 - 0.1 * attempts)).alias("confidence"), "errors")
    return union_all([*closed, left])


def export(made: DataFrame, path: str) -> DataFrame:
    """Writes generated questions as lines of JSON, sorted within files by topic, and returns one row of counts: total and verified_count. Topics without an item are counted, not written."""
    rows = made.where("item IS NOT NULL").select("topic", "verified", "attempts", "confidence", "errors", "item.*")
    rows.sortWithinPartitions("topic").write.mode("errorifexists").json(path)
    return made.agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified_count"))
