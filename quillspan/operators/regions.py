"""Regions of pages around equations, from the boxes of text spans.

Spans are rows: page, n (their order on the page), left, top, width, height, text.  They
are dealt by page and become lines: the spans of one height of a page, from left to right.
Boxes and lines of a page then meet where they lie, in merges by page that stream the lines
past the page's boxes, so nothing but lines is shuffled and no page is gathered anywhere.
What continues a span on a line of its own is read off that line, else found by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import Rounds, union_all

#: Distances in points: around an equals sign, along a row, above a region.
ACROSS, DOWN, MARGIN, GAP = 28, 9, 1, 3
ABOVE, RIGHT, LEFT, ROW = 45, 250, 30, 3
#: Longest text of a span of mathematics, its characters, and an equation within prose.
LONGEST = 80
SIGNS = "A-Za-z0-9µμΩΩπθρσΔ=+−–*/().^_ ×÷-"
INLINE = r"(?U)\b\d+\s+[A-Za-z]\s*=\s*\d+\s+[A-Za-z]\s*/\s*\d+\s+[A-Za-z]\b"
#: A heading after which a page has worked material.
HEADING = r"(?i)^\s*(?:Example\s+\d|Solution\b)"
#: Height of a cell of a page, and sides of one in which a span's end meets the next one's begin.
CELL_Y = 32
END_X, END_Y = 32, 16
BOX = ("x0", "y0", "x1", "y1")
#: Spans that a task holds, on average.
SPANS = 1 << 18


def mathematics(text: Column) -> Column:
    """Whether a span can be part of a formula: short, of its signs only, no word of four letters."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return ~text.rlike("[A-Za-z]{4}") & t.rlike(f"^[{SIGNS}]{{1,{LONGEST}}}$")


def by_page(spans: DataFrame) -> DataFrame:
    """The spans dealt by page, to so many tasks that each has SPANS of them on average."""
    return spans.repartition(max(spans.sparkSession.sparkContext.defaultParallelism, -(-spans.count() // SPANS)), "page")


def page_lines(spans: DataFrame, dealt: bool = False) -> DataFrame:
    """page, y0, y1, spans (of that height on the page, each once, from left to right) and alone: whether what goes on from them stays on the line, to the right.

    ``dealt``: the spans are dealt by page already.  Lines are written once, as all steps read them.
    """
    spot = F.struct(F.col("left").alias("x0"), "n", (F.col("left") + F.col("width")).alias("x1"), "text", mathematics(F.col("text")).alias("math"))
    rows = (spans if dealt else by_page(spans)).select("page", F.col("top").alias("y0"), (F.col("top") + F.col("height")).alias("y1"), spot.alias("s"))
    gathered = rows.groupBy("page", "y0", "y1").agg(F.sort_array(F.collect_list("s")).alias("all"))

    def first(s: Column, i: Column) -> Column:
        same = lambda u: u["x0"].eqNullSafe(s["x0"]) & u["x1"].eqNullSafe(s["x1"]) & u["text"].eqNullSafe(s["text"])
        return (i == 0) | (F.get("all", i - 1)["x0"] < s["x0"]) | ~F.exists(F.slice("all", 1, i), same)

    once = gathered.select("page", "y0", "y1", F.filter("all", first).alias("spans"))
    down = Window.partitionBy("page").orderBy("y0")
    apart = lambda gap: F.coalesce(gap > ROW, F.lit(True))
    alone = apart(F.col("y0") - F.lag("y0").over(down)) & apart(F.lead("y0").over(down) - F.col("y0")) & F.forall("spans", lambda s: s["x1"] - s["x0"] > ROW)
    return Rounds(spans.sparkSession, "lines").keep("lines", once.withColumn("alone", alone))


def tasks(lines: DataFrame) -> int:
    """So many that each has SPANS spans on average."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-(lines.agg(F.sum(F.size("spans"))).first()[0] or 0) // SPANS))


def deal(lines: DataFrame, n: int, *more: str) -> DataFrame:
    """The lines by page over n tasks: the same columns and filters for each step, so that they are dealt once for all."""
    return lines.select("page", "y0", "y1", "spans", *more).where("page IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL").repartition(n, "page")


def spans_of(lines: DataFrame) -> DataFrame:
    """The spans of lines, a row each, with their boxes."""
    return lines.select("page", "y0", "y1", F.explode("spans").alias("s")).select("page", "s.n", "s.text", "s.x0", "y0", "s.x1", "y1")


def first_boxes(lines: DataFrame, dealt: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """page, n (of the span with the equals sign) and the box around it and the mathematics near it, dealt by page over n tasks as the lines are in dealt."""
    anchor = lambda s: s["text"].contains("=") & (s["math"] | s["text"].rlike(INLINE))
    anchors = lines.select("page", F.col("y0").alias("ay0"), F.col("y1").alias("ay1"), F.explode(F.filter("spans", anchor)).alias("s"))
    anchors = anchors.select("page", "s.n", F.col("s.x0").alias("ax0"), "ay0", F.col("s.x1").alias("ax1"), "ay1").repartition(n, "page")
    near = dealt.select(F.col("page").alias("near_page"), "y0", "y1", "spans")
    down = (F.col("y0") <= F.col("ay1") + DOWN) & (F.col("y1") >= F.col("ay0") - DOWN)
    across = lambda s: s["math"] & (s["x0"] <= F.col("ax1") + ACROSS) & (s["x1"] >= F.col("ax0") - ACROSS)
    key = ["page", "n", "ax0", "ay0", "ax1", "ay1"]
    met = anchors.join(near.hint("merge"), (F.col("page") == F.col("near_page")) & down, "left").select(*key, "y0", "y1", F.filter("spans", across).alias("near"))
    ends = met.select(*key, F.array_min(F.transform("near", lambda s: s["x0"])).alias("x0"), "y0", F.array_max(F.transform("near", lambda s: s["x1"])).alias("x1"), "y1")
    of = lambda c: F.when(F.col("x0").isNotNull(), F.col(c))
    around = [F.least("ax0", F.min("x0")), F.least("ay0", F.min(of("y0"))), F.greatest("ax1", F.max("x1")), F.greatest("ay1", F.max(of("y1")))]
    found = ends.groupBy(*key).agg(*(c.alias(b) for c, b in zip(around, BOX, strict=True)))
    low = lambda c: F.greatest(F.lit(0.0), F.col(c).cast("double") - MARGIN)
    high = lambda c, most: F.least(F.col(most).cast("double"), F.col(c).cast("double") + MARGIN)
    return found.join(pages.repartition(n, "page").hint("merge"), "page").select("page", "n", low("x0").alias("x0"), low("y0").alias("y0"), high("x1", "page_width").alias("x1"), high("y1", "page_height").alias("y1"))


def grown(inside: DataFrame) -> DataFrame:
    """Boxes with the spans of their bands (inside, from left to right), widened again and again by spans that are at most GAP away.

    What a box can reach is found without rounds: the spans of a band fall into islands
    with more than GAP between them, and a box takes all islands that it touches, beyond
    which, by definition, nothing is near.
    """
    state = lambda *c: F.struct(*(v.alias(name) for v, name in zip(c, ("i0", "i1", "x0", "x1"), strict=True)))

    def taken(a: Column) -> tuple[Column, Column]:
        touched = (a["i0"] <= F.col("x1") + GAP) & (a["i1"] >= F.col("x0") - GAP)
        return F.when(touched, F.least(a["x0"], a["i0"])).otherwise(a["x0"]), F.when(touched, F.greatest(a["x1"], a["i1"])).otherwise(a["x1"])

    def step(a: Column, s: Column) -> Column:
        return F.when(s["x0"] <= a["i1"] + GAP, state(a["i0"], F.greatest(a["i1"], s["x1"]), a["x0"], a["x1"])).otherwise(state(s["x0"], s["x1"], *taken(a)))

    none = F.lit(None).cast("double")
    wide = F.aggregate("inside", state(none, none, F.col("x0"), F.col("x1")), step, lambda a: F.struct(*(c.alias(b) for c, b in zip(taken(a), ("x0", "x1"), strict=True))))
    # exploded, as a projection or filter above would else fold once more for each span that it looks at
    return inside.withColumn("wide", F.explode(F.array(wide))).withColumns({"x0": F.col("wide.x0"), "x1": F.col("wide.x1")}).drop("wide")


def regions_of(lines: DataFrame, pages: DataFrame, n: int | None = None) -> DataFrame:
    """The regions of equation_regions from page_lines, dealt by page over n tasks."""
    n = n or tasks(lines)
    dealt = deal(lines, n)
    boxes = first_boxes(lines, dealt, pages, n).groupBy("page", *BOX).agg(F.min("n").alias("n"))
    rows = dealt.select("page", F.col("y0").alias("sy0"), F.col("y1").alias("sy1"), "spans")
    band = boxes.join(rows.hint("merge"), "page").where("sy0 >= y0 AND sy1 <= y1")
    band = band.select("page", "n", *BOX, F.transform("spans", lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1"), F.xxhash64(s["x0"], "sy0", s["text"]).alias("sign"))).alias("spans"))
    wide = grown(band.groupBy("page", "n", *BOX).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("inside")))
    held = F.filter("inside", lambda s: (s["x0"] >= F.col("x0")) & (s["x1"] <= F.col("x1")))
    signs = wide.select("page", "n", *BOX, F.explode(F.array(F.sort_array(F.array_distinct(F.transform(held, lambda s: s["sign"]))))).alias("signs")).where(F.size("signs") > 0)
    kept = signs.groupBy("page", "signs").agg(F.min_by(F.struct("n", *BOX), "n").alias("b"))
    order = F.row_number().over(Window.partitionBy("page").orderBy("b.n")) - 1
    return kept.select("page", order.alias("region"), "b.*")


def equation_regions(spans: DataFrame, pages: DataFrame, dealt: bool = False) -> DataFrame:
    """page, region (from 0, in the order of the spans they began at) and box of the regions around equals signs.

    pages: page, page_width, page_height.  Of regions that hold the same spans the first is kept.
    ``dealt``: the spans are dealt by page already.
    """
    return regions_of(page_lines(spans, dealt), pages)


def candidates(spans: DataFrame, regions: DataFrame, heading: str = HEADING) -> DataFrame:
    """page, region, role, symbols, heading and preceding (text above) of each region.

    role is example_or_later if the region ends at or below the first heading of its
    page.  heading is the text of the last one that begins at or above it.  symbols are
    the single letters of its spans, sorted.  preceding joins the spans shortly above it,
    by top, left and order, and those that continue them on their rows.
    """
    return candidates_of(page_lines(spans), regions, heading)


def above(x0: Column, x1: Column) -> Column:
    """The spans of a line (alone, above a region from x0 to x1) that are near the region or go on to the right of such ones."""
    left, right = x0 - LEFT, x1 + RIGHT
    near = lambda s: (s["x1"] > left) & (s["x0"] < right)
    # what goes on beyond the edge begins at a span that ends near the edge or beyond it
    inner = F.filter("spans", lambda s: near(s) & (s["x1"] < right - ROW))
    edge = F.filter("spans", lambda s: near(s) & (s["x1"] >= right - ROW))
    beyond = F.filter("spans", lambda s: s["x0"] >= right)
    on = F.aggregate(beyond, edge, lambda a, s: F.when(F.exists(a, lambda u: F.abs(s["x0"] - u["x1"]) <= ROW), F.concat(a, F.array(s))).otherwise(a))
    return F.when(F.element_at("spans", -1)["x0"] < right, F.filter("spans", near)).otherwise(F.sort_array(F.concat(inner, on)))


def candidates_of(lines: DataFrame, regions: DataFrame, heading: str = HEADING, n: int | None = None) -> DataFrame:
    """The candidates of regions (dealt by page over n tasks) from page_lines: a region meets the lines of its band, those above it and those with headings in one merge by page.

    On a line with other lines at about its height, or with spans so narrow that one may
    go on to its left, what goes on is followed in rounds; on all others it is read off.
    """
    key = ["page", "region"]
    odd = lines.where("NOT alone")
    mixed = not odd.isEmpty()
    if mixed:
        regions = Rounds(lines.sparkSession, "regions").keep("regions", regions)
    dealt = deal(lines, n or tasks(lines), *(["alone"] if mixed else []))
    marks = F.filter("spans", lambda s: s["text"].rlike(heading))
    rows = dealt.select("page", F.col("y0").alias("sy0"), F.col("y1").alias("sy1"), "spans", F.col("alone") if mixed else F.lit(True).alias("alone"), F.array_max(F.transform(marks, lambda s: F.struct(s["n"].alias("n"), s["text"].alias("text")))).alias("mark"))
    inside = (F.col("sy0") >= F.col("y0")) & (F.col("sy1") <= F.col("y1"))
    over = F.col("alone") & (F.col("sy0") >= F.col("y0") - ABOVE) & (F.col("sy1") <= F.col("y0"))
    marked = F.col("mark").isNotNull()
    boxes = regions.select(*key, *BOX)
    met = boxes.join(rows.withColumnRenamed("page", "line_page").hint("merge"), (F.col("page") == F.col("line_page")) & (inside | over | marked), "left")
    held = F.array_join(F.transform(F.filter("spans", lambda s: (s["x0"] >= F.col("x0")) & (s["x1"] <= F.col("x1"))), lambda s: s["text"]), "\n")
    letters = F.regexp_extract_all(held, F.lit("(?<![A-Za-z])[A-Za-z](?![A-Za-z])"), F.lit(0))
    words = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), " ")
    taken = above(F.col("x0"), F.col("x1"))
    parts = met.select(
        *key,
        "y1",
        F.when(inside, letters).alias("letters"),
        F.when(over & F.exists("spans", lambda s: (s["x1"] > F.col("x0") - LEFT) & (s["x0"] < F.col("x1") + RIGHT)), F.struct("sy0", words(taken).alias("text"))).alias("above"),
        F.when(marked & (F.col("sy0") <= F.col("y0")), F.struct("sy0", "mark.n", "mark.text")).alias("last"),
        F.when(marked, F.col("sy0")).alias("top"),
    )
    gathered = parts.groupBy(*key, "y1").agg(F.flatten(F.collect_list("letters")).alias("letters"), F.collect_list("above").alias("above"), F.max("last").alias("last"), F.min("top").alias("top"))
    if mixed:
        rows = preceding(spans_of(odd), regions).groupBy(*key, "sy0").agg(F.sort_array(F.collect_list(F.struct("sx0", "sn", "text"))).alias("spans"))
        followed = rows.groupBy(*key).agg(F.collect_list(F.struct("sy0", words("spans").alias("text"))).alias("followed"))
        gathered = gathered.join(followed, key, "left").withColumn("above", F.when(F.col("followed").isNull(), F.col("above")).otherwise(F.concat("above", "followed")))
    role = F.when(F.col("y1") >= F.col("top"), "example_or_later").otherwise("unclassified_source")
    return gathered.select(*key, role.alias("role"), F.sort_array(F.array_distinct("letters")).alias("symbols"), F.col("last.text").alias("heading"), words(F.sort_array("above")).alias("preceding"))


def preceding(once: DataFrame, regions: DataFrame) -> DataFrame:
    """page, region and the spans (s-columns, text) above each region: near it, or going on to the right of such a span.

    A span goes on if it begins within ROW of where one of about the same height ends;
    such pairs are found once, by cell, and followed in rounds of new spans only.
    """
    spans = once.select("page", "text", F.col("n").alias("sn"), *(F.col(b).alias(f"s{b}") for b in BOX))
    cy = lambda c: F.floor(c / CELL_Y).cast("int")
    asked = regions.select("page", "region", "x0", "y0", "x1", F.explode(F.sequence(cy(F.col("y0") - ABOVE), cy(F.col("y0")))).alias("cy"))
    near = asked.join(spans.withColumn("cy", cy(F.col("sy0"))).hint("merge"), ["page", "cy"])
    near = near.where((F.col("sy0") >= F.col("y0") - ABOVE) & (F.col("sy1") <= F.col("y0")) & (F.col("sx0") < F.col("x1") + RIGHT) & (F.col("sx1") > F.col("x0") - LEFT))
    near = near.select("page", "region", "y0", "sn")
    # a span's end, in all cells where what goes on may begin, meets the begins of their own cell; sizes of exploded spans are unknown, so none is broadcast
    about = lambda v, side: F.sequence(F.floor((v - ROW) / side).cast("int"), F.floor((v + ROW) / side).cast("int"))
    ends = spans.select("page", F.col("sn").alias("from_n"), F.col("sx1").alias("end_x"), F.col("sy0").alias("from_y"), F.explode(about(F.col("sx1"), END_X)).alias("cx"))
    ends = ends.withColumn("cy", F.explode(about(F.col("from_y"), END_Y)))
    starts = spans.select("page", "sn", "sx0", "sy0", "sy1", F.floor(F.col("sx0") / END_X).cast("int").alias("cx"), F.floor(F.col("sy0") / END_Y).cast("int").alias("cy"))
    goes_on = ends.hint("merge").join(starts, ["page", "cx", "cy"]).where((F.abs(F.col("sy0") - F.col("from_y")) <= ROW) & (F.abs(F.col("sx0") - F.col("end_x")) <= ROW) & (F.col("sn") != F.col("from_n")))
    goes_on = goes_on.select("page", "from_n", F.col("sn").alias("to_n"), F.col("sy1").alias("to_end"))

    rounds = Rounds(once.sparkSession, "preceding")
    goes_on = rounds.keep("goes-on", goes_on)
    new = rounds.keep("new-0", near.distinct())
    found, n = [new], 0
    while not new.isEmpty():
        n += 1
        step = new.withColumnRenamed("sn", "from_n").join(goes_on.hint("merge"), ["page", "from_n"]).where("to_end <= y0").select("page", "region", "y0", F.col("to_n").alias("sn")).distinct()
        new = rounds.keep(f"new-{n}", step.join(union_all(found), ["page", "region", "sn"], "left_anti").select("page", "region", "y0", "sn"))
        found.append(new)
    return union_all(found).select("page", "region", "sn").join(spans.hint("merge"), ["page", "sn"])
