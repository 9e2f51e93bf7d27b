"""Structure of source documents: module order, anchors and what they refer to, page layout, worked examples."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tags of tasks and of visuals.
TASKS = {"exercise", "example", "solution"}
VISUALS = {"figure", "media", "image", "table"}
#: Characters between an example's heading and its solution, at most.
REACH = 8000
#: Fixed values, in points: middles of one line, where a gap is a blank, how far off an exponent may stand, and its size.
SAME_LINE, BLANK, TOUCHING, RAISED, SMALL = 3, 3, (-2, 3), 1, 0.75
#: Quantities, by their words, that are read together with a one-letter symbol.
LABELS = (
    "electric charge", "electric current", "potential difference", "charge", "current", "time", "resistance", "voltage",
    "work done", "work", "force", "distance", "speed", "acceleration",
)
LABEL_WORDS = sorted((tuple(x.split()) for x in LABELS), key=len, reverse=True)


def name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def per_row(df: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """Rows that a function of a row's columns gives, batch by batch."""
    names = [f.split()[0] for f in re.sub(r"<.*?>", "", schema).split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([out for row in frame.itertuples(index=False) for out in run(*row)], columns=names)

    return df.select(*columns).mapInPandas(batches, schema)


def module_order(collections: DataFrame) -> DataFrame:
    """Modules of collections (collection_id, xml) in order: chapters count subcollections, loose modules have chapter 0."""

    def walk(collection: str, xml: str | None):
        content = next((c for c in ET.fromstring(xml) if name(c) == "content"), ()) if xml else ()
        chapter, order = 0, 0
        for part in content:
            nested = name(part) == "subcollection"
            chapter += nested
            for module in part.iter() if nested else (part,):
                if name(module) == "module":
                    yield collection, order, module.get("document"), chapter if nested else 0
                    order += 1

    return per_row(collections, ["collection_id", "xml"], walk, "collection_id string, module_order int, module_id string, chapter int")


def anchors(modules: DataFrame) -> DataFrame:
    """Elements with an id of modules (module_id, xml): their role by ancestry, whether tasks or visuals lie below, and what they refer to."""

    def walk(module: str, xml: str | None):
        stack = [(ET.fromstring(xml), False)] if xml else []
        while stack:
            node, task = stack.pop()
            task = task or name(node) in TASKS or "section-exercises" in (node.get("class") or "").split()
            stack += [(child, task) for child in node]
            if node.get("id"):
                below = list(node.iter())
                tags = {name(n) for n in below}
                inner = any(name(n) in TASKS for n in below[1:])
                yield module, node.get("id"), "exercise_material" if task else "exposition", inner, bool(tags & VISUALS), [n.get("target-id") for n in below if n.get("target-id")]

    return per_row(modules, ["module_id", "xml"], walk, "module_id string, anchor string, role string, has_tasks boolean, visual boolean, refers array<string>")


def anchor_flags(modules: DataFrame) -> DataFrame:
    """anchors() with ``external``: whether one refers to what its module hasn't, or to a visual."""
    found = anchors(modules)
    there = found.groupBy("module_id", F.col("anchor").alias("target")).agg(F.bool_or("visual").alias("shows"))
    links = found.select("module_id", "anchor", F.explode("refers").alias("target")).distinct()
    outside = links.join(there, ["module_id", "target"], "left").groupBy("module_id", "anchor").agg(F.bool_or(F.coalesce("shows", F.lit(True))).alias("external"))
    return found.select("module_id", "anchor", "role", "has_tasks").join(outside, ["module_id", "anchor"], "left").withColumn("external", F.coalesce("external", F.lit(False)))


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines of pages (page_id, left, top, width, height, font_size, content): page_id, line and content.

    Spans whose middles follow each other at SAME_LINE points at most are one line.  In
    a line a small raised whole number after a letter, digit or bracket is written as an
    exponent, and wider gaps as a blank.
    """
    middle = F.col("top") + F.col("height") / 2
    down = Window.partitionBy("page_id").orderBy("middle", "left", "content")
    step = F.coalesce((F.col("middle") - F.lag("middle").over(down) > SAME_LINE).cast("int"), F.lit(0))
    lined = spans.withColumn("middle", middle).withColumn("step", step).withColumn("line", F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("page_id", "line").orderBy("left", "top", "content")
    before = lambda c: F.lag(c).over(along)
    gap, base = F.col("left") - before("left") - before("width"), F.rtrim(before("content"))
    body = F.rtrim("content")
    digits = F.translate(F.trim("content"), "\u2212\u2013", "--")
    higher = F.col("top") + F.col("height") < before("top") + before("height") - RAISED
    exponent = higher & (F.col("font_size") <= SMALL * before("font_size")) & gap.between(*TOUCHING) & digits.rlike("^[-+]?[0-9]+$") & F.substring(base, -1, 1).rlike("[A-Za-z0-9)]")
    rest = F.substring(F.col("content"), F.length(body) + 1, F.length("content"))
    piece = F.when(exponent, F.concat(F.lit("^("), digits, F.lit(")"), rest)).when(gap > BLANK, F.concat(F.lit(" "), "content")).otherwise(F.col("content"))
    pieces = lined.select("page_id", F.col("line").cast("int").alias("line"), F.row_number().over(along).alias("n"), piece.alias("piece"))
    return pieces.groupBy("page_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda p: p["piece"]), "").alias("content"))


def worked_examples(texts: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """key, example (its number), start, end and page of the first ``most`` examples of each text whose solution is marked within REACH characters, before the next example.

    Headings are lines (a new page begins one): "Example", a number and maybe a mark, and
    "Solution".  Lines are numbered and measured, headings alone go on, and each example
    looks at the next heading of either kind.  Of examples of one number the first counts.
    ``key`` is unique; pages count from 1.
    """
    parts = F.arrays_zip(F.split(F.col(text), r"[\n\f]").alias("line"), F.regexp_extract_all(F.col(text), F.lit(r"[\n\f]"), F.lit(0)).alias("mark"))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(parts).alias("i", "p"))
    token = lambda n: F.rtrim(F.coalesce(F.get(F.split(F.trim(F.translate("p.line", "\t", " ")), " +"), F.lit(n)), F.lit("")), F.lit(":."))
    number = F.when((token(0) == "Example") & token(1).rlike(r"^[0-9]+(\.[0-9]+)?$"), token(1))
    rows = rows.select("key", "i", F.length("p.line").alias("size"), (F.col("p.mark") == "\f").alias("feeds"), number.alias("number"), (token(0) == "Solution").alias("solution"))
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    placed = rows.select("key", "i", "number", "solution", (total("size") + F.col("i")).cast("int").alias("at"), (total(F.coalesce(F.col("feeds").cast("int"), F.lit(0))) + 1).cast("int").alias("page"))
    heads = placed.where("number IS NOT NULL OR solution")
    line = Window.partitionBy("key").orderBy("i")
    heads = heads.withColumns({"next": F.lead("at").over(line), "answers": F.lead("solution").over(line)}).where("number IS NOT NULL")
    first = heads.withColumn("nth", F.row_number().over(Window.partitionBy("key", "number").orderBy("i"))).where("nth = 1")
    solved = first.where(F.col("answers") & (F.col("next") - F.col("at") <= REACH))
    taken = solved.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= most)
    return taken.select(F.col("key").alias(key), F.col("number").alias("example"), F.col("at").alias("start"), F.col("next").alias("end"), "page")


def opens_example(text: str) -> bool:
    """Whether a text begins with the heading of an example or of a solution."""
    first = text.split(None, 2)[:2]
    return bool(first) and (first[0].rstrip(":.") == "Solution" or first[0] == "Example" and len(first) > 1 and first[1][0].isdigit())


def label_at(words: list[tuple[str, int, int]], i: int) -> tuple[str, int] | None:
    """The longest quantity that stands at a word, and the number of its words."""
    for label in LABEL_WORDS:
        if tuple(w.lower() for w, _, _ in words[i : i + len(label)]) == label:
            return " ".join(label), len(label)
    return None


def symbol_mentions(text: str | None) -> list[tuple[str, str, int, int]]:
    """Quantity, symbol and offsets of the places where a text names both; questions and worked examples have none.

    A symbol is one letter.  After a quantity it stands in parentheses, or bare if a mark,
    "and" or the text's end follows; before one, "for" or "for the" joins them.  A bare
    small "a" is an article.
    """
    if not text or text.rstrip().endswith("?") or opens_example(text):
        return []
    words = [(m[0], *m.span()) for m in re.finditer(r"\w+|\S", text)]
    out = []

    def letter(i: int) -> bool:
        return i < len(words) and len(words[i][0]) == 1 and words[i][0].isascii() and words[i][0].isalpha()

    def spaced(i: int) -> bool:
        return words[i][1] > words[i - 1][2]

    inside = 0  # words before this one belong to the last quantity
    for i in range(len(words)):
        found = label_at(words, i) if i >= inside else None
        if found:
            label, n = found
            inside = i + n
            at = i + n
            if at + 2 < len(words) and words[at][0] == "(" and spaced(at) and letter(at + 1) and words[at + 2][0] == ")":
                if words[at][2] == words[at + 1][1] and words[at + 1][2] == words[at + 2][1]:
                    out.append((label, words[at + 1][0], words[i][1], words[at + 2][2]))
            elif letter(at) and words[at][0] != "a" and (at + 1 == len(words) or words[at + 1][0] in (",", ";", ".") or words[at + 1][0] == "and"):
                out.append((label, words[at][0], words[i][1], words[at][2]))
        if letter(i) and words[i][0] != "a":
            at = i + 1 + (i + 1 < len(words) and words[i + 1][0] == "," and not spaced(i + 1))
            if at < len(words) and words[at][0] == "for":
                at += 1 + (at + 1 < len(words) and words[at + 1][0] == "the")
                found = label_at(words, at)
                if found:
                    out.append((found[0], words[i][0], words[i][1], words[at + found[1] - 1][2]))
    return sorted((("work" if label == "work done" else label, *rest) for label, *rest in out), key=lambda m: m[2])


def mentions_column(text: Column) -> Column:
    return F.udf(symbol_mentions, "array<struct<quantity:string,symbol:string,start:int,end:int>>", useArrow=True)(text)
