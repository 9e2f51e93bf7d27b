"""Bracketed calls in texts, with offsets: brackets as rows, matched by their running depth.

An opening bracket at some level meets the next closing one at that level, however many
brackets of either kind are left over before or after.  Only positions are shuffled,
and the sorts behind the two windows spill, so a text's length has no bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Brackets that a task puts in order.
MARKS = 1 << 20
#: The names of functions; any one letter counts as well.
NAMES = ("sqrt", "root", "ln", "log", "sin", "cos", "tan", "exp")


def calls(texts: DataFrame, key: str, text: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """key, start, end (offset after the closing bracket), name and level of every balanced call ``name(...)`` of every text; levels count brackets that are open around it.

    ``key`` is unique.  Null texts and texts without brackets have no calls; a call that
    isn't closed isn't one.  Brackets are dealt by text to so many tasks that each sorts
    MARKS of them on average.
    """
    name = rf"(?U)\b(?:{'|'.join(names)}|[A-Za-z])\s*$"
    pieces = F.arrays_zip(F.split(F.col(text), r"[()]").alias("piece"), F.regexp_extract_all(F.col(text), F.lit(r"[()]"), F.lit(0)).alias("mark"))
    rows = texts.where(F.col(text).contains("(")).select(F.col(key).alias("key"), F.posexplode(pieces).alias("i", "p")).where("p.mark IS NOT NULL")
    bare = F.replace(F.replace(F.col(text), F.lit("(")), F.lit(")"))
    marks = texts.agg(F.sum(F.length(text) - F.length(bare))).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-marks // MARKS))
    rows = rows.select("key", "i", F.length("p.piece").cast("long").alias("size"), (F.col("p.mark") == "(").alias("opens"), F.when(F.col("p.mark") == "(", F.regexp_extract("p.piece", name, 0)).alias("named")).repartition(parts, "key")
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("key", "i", "opens", "named", (F.sum("size").over(so_far) + F.col("i")).alias("at"), F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(so_far).alias("depth"))
    placed = placed.withColumn("level", F.col("depth") - F.when(F.col("opens"), 1).otherwise(0))
    matched = placed.withColumn("close", F.lead("at").over(Window.partitionBy("key", "level").orderBy("i")))
    found = matched.where("opens AND named != '' AND close IS NOT NULL")
    return found.select(F.col("key").alias(key), (F.col("at") - F.length("named")).alias("start"), (F.col("close") + 1).alias("end"), F.regexp_extract("named", "^[A-Za-z]+", 0).alias("name"), F.col("level").cast("long").alias("level"))


def expressions(texts: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """key and the distinct calls of each text as they are written, without white space, sorted; ``found`` is what ``calls`` gives."""
    spots = found.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("spots"))
    cut = lambda s: F.regexp_replace(F.substring(F.col(text), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), r"(?U)\s+", "")
    return texts.join(spots, key).select(key, F.array_sort(F.array_distinct(F.transform("spots", cut))).alias("expressions"))
