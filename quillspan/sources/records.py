"""Sources: ordered records from JSON lines, spans from text, blocks and regions from XML and HTML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import let
from ..operators.ranges import running

RECORD = "id string, content string, source_id string, chapter int, module_order int, position long, module_id string, anchor string, kind string, title string, is_target boolean, unsupported_mathml array<string>, has_media boolean, references array<struct<module:string,anchor:string>>"


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records from JSON lines under a fixed schema; malformed lines stop the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def repeated_ids(records: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once, or are missing."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def require_unique(records: DataFrame, key: str = "id") -> DataFrame:
    """The records themselves; raises when an action meets a repeated or missing id."""
    bad = repeated_ids(records, key).select(F.count(F.lit(1)).alias("__bad"))
    checked = records.crossJoin(F.broadcast(bad))  # one row
    return checked.where(F.when(F.col("__bad") > 0, F.raise_error(F.lit(f"repeated or missing {key}"))).otherwise(F.lit(True))).drop("__bad")


def line_spans(text: Column) -> Column:
    """Lines that aren't blank as structs of content and half-open character offsets."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<content:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        left = acc["at"] + F.length(line) - F.length(F.ltrim(line))
        span = F.struct(F.trim(line).alias("content"), left.alias("start"), (left + F.length(F.trim(line))).alias("end"))
        out = F.when(F.trim(line) == "", acc["out"]).otherwise(F.array_append(acc["out"], span))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def locate_once(text: Column, anchor: Column) -> Column:
    """0-based place of an anchor that occurs exactly once; null otherwise."""
    times = (F.length(text) - F.length(F.replace(text, anchor, F.lit("")))) / F.length(anchor)
    return F.when(times == 1, F.instr(text, anchor) - 1)


def global_positions(records: DataFrame, module: str, ordinal: str) -> DataFrame:
    """Adds ``position``: the record's place over all modules in module order.

    Modules are numbered by their counts alone; records are only joined with their
    module's first place.
    """
    counts = records.groupBy(module).agg(F.count(F.lit(1)).alias("__n"))
    first = running(counts, [module], F.col("__n"), "__first").select(module, "__first")
    return records.join(first, module).withColumn("position", F.col("__first") + F.col(ordinal)).drop("__first")


_MATH = {"mfrac": "(({0})/({1}))", "msup": "({0})^({1})", "msub": "({0})_({1})", "msqrt": "sqrt({0})", "mroot": "root({1}, {0})"}


def render(node: ET.Element, unknown: set[str]) -> str:
    """Text of an XML block, formulas in one line; tags that can't be shown are added to ``unknown``."""
    tag = node.tag.rpartition("}")[2]
    inner = [render(child, unknown) + (child.tail or "") for child in node]
    if tag in _MATH and tag != "msqrt":
        parts = [x.strip() for x in inner]
        if len(parts) != 2:
            unknown.add(tag)
        return _MATH[tag].format(*(parts + ["", ""])[:2])
    text = (node.text or "") + "".join(inner)
    if tag == "msqrt":
        return _MATH[tag].format(text.strip())
    if tag in ("media", "image", "figure"):
        return "[unrendered-media]"
    if tag == "link" and node.get("target-id"):
        return text or f"[reference:{node.get('document', '')}#{node.get('target-id')}]"
    if tag.startswith("m") and tag not in ("math", "mrow", "mi", "mn", "mo", "mtext", "mspace", "mstyle", "mtable", "mtr", "mtd", "msub"):
        unknown.add(tag)
    return text


BLOCKS = ("para", "equation", "note", "rule", "definition", "example", "exercise")
BLOCK_SCHEMA = "module_id string, ordinal int, kind string, anchor string, content string, unsupported array<string>, role string"


def module_blocks(module_id: str, xml: str) -> list[tuple]:
    """Blocks of one module in document order: outermost of BLOCKS; an exercise gives its problem only."""
    out: list[tuple] = []

    def visit(node: ET.Element, role: str) -> None:
        for child in node:
            tag = child.tag.rpartition("}")[2]
            own = "exercise_material" if tag in ("exercise", "solution", "example") or "exercises" in (child.get("class") or "") else role
            if tag in BLOCKS:
                shown = next((p for p in child if p.tag.rpartition("}")[2] == "problem"), None) if tag == "exercise" else child
                unknown: set[str] = set()
                text = " ".join(render(shown, unknown).split()) if shown is not None else ""
                if text:
                    out.append((module_id, len(out), tag, child.get("id"), text, sorted(unknown), own))
            else:
                visit(child, own)

    visit(ET.fromstring(xml), "instruction")
    return out


def extract_modules(modules: DataFrame) -> DataFrame:
    """Blocks of CNXML modules (columns module_id and xml), one row per block."""
    names = ["module_id", "ordinal", "kind", "anchor", "content", "unsupported", "role"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([b for m, x in zip(frame["module_id"], frame["xml"], strict=True) for b in module_blocks(m, x)], columns=names)

    return modules.select("module_id", "xml").mapInPandas(run, BLOCK_SCHEMA)


def page_spans(xml: Column) -> Column:
    """Text spans of a page in XML: an array of left, top, width, height and content."""
    fields = {"left": "double", "top": "double", "width": "double", "height": "double"}
    arrays = [F.xpath(xml, F.lit(f"//text/@{k}")).cast(f"array<{kind}>").alias(k) for k, kind in fields.items()]
    read = F.struct(*arrays, F.xpath(xml, F.lit("//text/text()")).alias("content"))  # a page is parsed once for each field, not for each span
    return let(read, lambda a: F.transform(F.sequence(F.lit(0), F.size(a["content"]) - 1), lambda i: F.struct(*(F.get(a[k], i).alias(k) for k in (*fields, "content")))))


def crop(spans: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Spans by how they lie to a box (x0, y0, x1, y1): ``inside`` or ``clipped``; others go."""
    x0, y0, x1, y1 = box
    left, top, right, bottom = F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")
    inside = (left >= x0) & (top >= y0) & (right <= x1) & (bottom <= y1)
    touches = (left < x1) & (right > x0) & (top < y1) & (bottom > y0)
    return spans.where(touches).withColumn("state", F.when(inside, "inside").otherwise("clipped"))
