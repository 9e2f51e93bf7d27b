"""Ordered corpora: records with source_id and position, and what a target may see of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scope import is_blank

#: Roles and kinds that never count as teaching material.
HIDDEN_ROLES = ("exercise_material", "unknown")
HIDDEN_KINDS = ("exercise", "example")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Conversations as a corpus: a source per conversation, a position per turn."""
    return conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("source_id"), F.col("turn").alias("position"), F.col("text").alias("content"), F.lit("para").alias("kind"))


def last_turns(conversations: DataFrame) -> DataFrame:
    """The last turn of each conversation as a target."""
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("target_position"))
    return last.select(F.concat_ws(":", "conv_id", "target_position").alias("target_id"), F.col("conv_id").alias("target_source"), "target_position")


def eligible_records(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of target and record: same source, earlier, teaching material, not blank.

    Optional columns of the records are respected: instructional_role, kind,
    unsupported_mathml (array), contains_exercise_content, requires_external_media with
    excerpt {quote, start, end, parent_sha256}; a record that needs media is seen only
    through an excerpt that its hash and offsets confirm.
    """
    have = set(records.columns)
    if "instructional_role" in have:
        records = records.where(~F.coalesce("instructional_role", F.lit("unknown")).isin(*HIDDEN_ROLES))
    if "kind" in have:
        records = records.where(~F.coalesce("kind", F.lit("")).isin(*HIDDEN_KINDS))
    if "unsupported_mathml" in have:
        records = records.where(F.coalesce(F.size("unsupported_mathml"), F.lit(0)) <= 0)
    if "contains_exercise_content" in have:
        records = records.where(~F.coalesce("contains_exercise_content", F.lit(False)))
    if "requires_external_media" in have:
        e = F.col("excerpt")
        cut = F.substring("content", e["start"] + 1, e["end"] - e["start"])
        sound = (F.sha2(F.col("content").cast("binary"), 256) == e["parent_sha256"]) & (cut == e["quote"])
        media = F.coalesce("requires_external_media", F.lit(False))
        records = records.where(~media | F.coalesce(sound, F.lit(False))).withColumn("content", F.when(media, cut).otherwise(F.col("content")))
    near = (F.col("source_id") == F.col("target_source")) & (F.col("position") < F.col("target_position"))
    return records.where(~is_blank(F.col("content"))).join(targets, near)


#: Where a unit ends: a sentence's mark, maybe with a closing quote or bracket, before a capital or an opening bracket; or blank lines.
_CUT = r"(?<=[.!?][\"'\u201d\u2019)\]]?)\s+(?=\(|[A-Z])|\s*\n[ \t]*\n\s*"


def evidence_units(texts: DataFrame, key: str, text: str, offset: Column | None = None) -> DataFrame:
    """key, unit (from 0), content, start and end of the sentence-like units of each text, without the white space around them.

    Texts are split at the cuts; what is cut out is as long as it was, so offsets are
    running lengths, from ``offset`` on.  ``key`` is unique; null texts have no units.
    """
    pieces = F.arrays_zip(F.split(F.col(text), _CUT).alias("piece"), F.regexp_extract_all(F.col(text), F.lit(_CUT), F.lit(0)).alias("cut"))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), (F.lit(0) if offset is None else offset).cast("long").alias("offset"), F.posexplode(pieces).alias("i", "p"))
    size = F.length("p.piece") + F.coalesce(F.length("p.cut"), F.lit(0))
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.col("offset") + F.coalesce(F.sum(size).over(so_far), F.lit(0)))
    left = F.regexp_replace("p.piece", r"^\s+", "")
    content = F.regexp_replace(left, r"\s+$", "")
    start = F.col("at") + F.length("p.piece") - F.length(left)
    found = placed.where(content != "").select("key", "i", content.alias("content"), start.alias("start"), (start + F.length(content)).alias("end"))
    unit = F.row_number().over(Window.partitionBy("key").orderBy("i")) - 1
    return found.select(F.col("key").alias(key), unit.alias("unit"), "content", "start", "end")


def with_structure(records: DataFrame, anchors: DataFrame, pins: DataFrame) -> DataFrame:
    """records (id, content) with role (of ``anchors``: id, role; unknown without one) and state against the pinned digests (``pins``: id, sha256): ok, changed or unpinned.

    What isn't ok must not be rendered again; the caller stops on it or leaves it out.
    """
    joined = records.join(anchors.select("id", "role"), "id", "left").join(pins.select("id", "sha256"), "id", "left")
    same = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256) == F.col("sha256")
    state = F.when(F.col("sha256").isNull(), "unpinned").when(same, "ok").otherwise("changed")
    return joined.withColumn("role", F.coalesce("role", F.lit("unknown"))).withColumn("state", state).drop("sha256")
