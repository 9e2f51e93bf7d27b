"""Staged extraction: what a model proposed, held against reviews and the words of the source, with offsets into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities, witness
from ..functions.scope import is_worked_example


def located(text: Column, quote: Column) -> Column:
    """start and end of the first place of a quote in a text, where white space and capitals may differ; null if it isn't there or has no word.

    The quote's words, taken literally, are looked for with any white space between them,
    so the place is one of the text itself and nothing has to be mapped back.
    """
    literal = F.transform(F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit("(?iuU)"), F.array_join(literal, r"\s+"))
    start = F.regexp_instr(text, pattern) - 1
    found = F.call_function("regexp_extract", text, pattern, F.lit(0))
    return F.when((F.size(literal) > 0) & (start >= 0), F.struct(start.cast("long").alias("start"), (start + F.length(found)).cast("long").alias("end")))


def mentioned(name: Column, text: Column) -> Column:
    """Whether a name stands in a text as whole words."""
    plain = F.concat(F.lit(" "), F.array_join(witness.words(F.regexp_replace(text, r"[.;,:!?()\[\]\"“”]", " ")), " "), F.lit(" "))
    return F.contains(plain, F.concat(F.lit(" "), F.array_join(witness.name_words(name), " "), F.lit(" "))) & (F.size(witness.name_words(name)) > 0)


def usable(units: DataFrame) -> DataFrame:
    """Units that may be cited: no questions, no worked examples."""
    return units.where(~F.rtrim("content").endswith("?") & ~is_worked_example(F.col("content")))


def judge_entities(units: DataFrame, entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """entities (source, claim, name, role, unit, layout_verified) with reason (null: accepted) and their unit's content and offsets.

    units: source, unit, content, start, end; reviews: source, claim, verdict.
    """
    joined = entities.join(usable(units), ["source", "unit"], "left").join(reviews, ["source", "claim"], "left")
    role = F.col("role")
    reason = (
        F.when(F.col("content").isNull(), "unknown_evidence")
        .when(~mentioned(F.col("name"), F.col("content")), "no_literal_mention")
        .when((role == "definition") & ~quantities.definition_witness(F.col("name"), F.col("content")), "no_definition_wording")
        .when((role == "formula") & ~F.coalesce("layout_verified", F.lit(False)), "layout_unverified")
        .when(F.coalesce("verdict", F.lit("MISSING")) != "SUPPORTED", "review")
    )
    return joined.select("source", "claim", "name", "role", "unit", "content", "start", "end", reason.alias("reason"))


def judge_relations(units: DataFrame, relations: DataFrame, reviews: DataFrame, judged: DataFrame) -> DataFrame:
    """relations (source, claim, kind, from_name, to_name, unit) with reason (null: accepted), and the quote that states them: its start and end in the source, and text there.

    ``judged`` is what judge_entities gives: both ends have to be accepted names of the source.
    """
    names = judged.where("reason IS NULL").select("source", "name").distinct()
    joined = relations.join(usable(units), ["source", "unit"], "left").join(reviews, ["source", "claim"], "left")
    for end in ("from_name", "to_name"):
        joined = joined.join(names.select("source", F.col("name").alias(end), F.lit(True).alias(f"{end}_known")), ["source", end], "left")
    stated = joined.withColumn("witness", witness.relation_witness(F.col("kind"), F.col("from_name"), F.col("to_name"), F.col("content")))
    placed = stated.withColumn("place", located(F.col("content"), F.col("witness")))
    reason = (
        F.when(F.col("content").isNull(), "unknown_evidence")
        .when(F.col("witness").isNull(), "no_directional_witness")
        .when(F.coalesce("verdict", F.lit("MISSING")) != "SUPPORTED", "review")
        .when(F.col("from_name_known").isNull() | F.col("to_name_known").isNull(), "endpoint_not_accepted")
    )
    text = F.substring(F.col("content"), F.col("place.start").cast("int") + 1, (F.col("place.end") - F.col("place.start")).cast("int"))
    return placed.select("source", "claim", "kind", "from_name", "to_name", "unit", reason.alias("reason"), (F.col("start") + F.col("place.start")).alias("quote_start"), (F.col("start") + F.col("place.end")).alias("quote_end"), text.alias("quote"))
