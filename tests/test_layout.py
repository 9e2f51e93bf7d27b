"""Structure of sources on single documents."""

from quillspan.sources import layout


def span(left, top, text, height=10.0, font=10.0):
    return {"left": left, "top": top, "width": 5.0, "height": height, "font_size": font, "content": text}


SPANS = "page_id long, left double, top double, width double, height double, font_size double, content string"


def lines_of(spark, spans, page=1):
    rows = [(page, *(float(s[c]) for c in ("left", "top", "width", "height", "font_size")), s["content"]) for s in spans]
    return sorted((r.line, r.content) for r in layout.page_lines(spark.createDataFrame(rows, SPANS)).collect())


def test_exponents_and_lines(spark):
    spans = [span(0, 10, "x"), span(5, 10, "\u22122", 6.0, 6.0), span(20, 11, "= 1"), span(0, 40, "end")]
    assert lines_of(spark, spans) == [(0, "x^(-2) = 1"), (1, "end")]
    assert lines_of(spark, []) == []
    assert lines_of(spark, [span(0, 10, "x"), span(5, 10, "2")]) == [(0, "x2")]  # not raised
    assert lines_of(spark, [span(0, 10, "("), span(5, 10, "2 ", 6.0, 6.0), span(10, 10, "y) "), span(14, 10, "3 ", 5.0, 5.0), span(16, 10, "a")]) == [(0, "(2 y) ^(3) a")]


def examples_of(spark, *texts):
    found = layout.worked_examples(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text").collect()
    return sorted((r.k, r.start, r.example, r.end, r.page) for r in found)


def test_worked_examples(spark):
    text = "Example 1.1 a\nSolution b\fExample 1.2 c\nExample 1.1 d\nSolution\nExample 2 " + "x" * 9000 + "\nSolution\nExample 3: e\nSolution"
    found = examples_of(spark, text, None, "", "Example\nSolution", "Example x\nSolution", "  Example 7.\n\t Solution: s\nExample 8\nExample 9\nSolution\nExample 10\nSolution")
    assert [(k, n, page) for k, _, n, _, page in found] == [(0, "1.1", 1), (0, "3", 2), (5, "7", 1), (5, "9", 1)]
    assert all(text[s:].startswith("Example") and text[e:].startswith("Solution") for k, s, _, e, _ in found if k == 0)


def test_symbol_mentions():
    text = "The Electric current (I), voltage V, and W for work done."
    found = layout.symbol_mentions(text)
    assert [m[:2] for m in found] == [("electric current", "I"), ("voltage", "V"), ("work", "W")]
    assert [text[a:b] for *_, a, b in found] == ["Electric current (I)", "voltage V", "W for work done"]
    assert layout.symbol_mentions("Is it current I?") == layout.symbol_mentions(None) == []


def test_anchors(spark):
    xml = "<doc id='d'><para id='a'><link target-id='t'/><link target-id='gone'/></para><table id='t'/><example id='x'><para id='y'/></example></doc>"
    df = spark.createDataFrame([("m", xml), ("none", None)], "module_id string, xml string")
    rows = {r["anchor"]: (r["role"], r["has_tasks"], r["external"]) for r in layout.anchor_flags(df).collect()}
    assert rows == {"d": ("exposition", True, True), "a": ("exposition", False, True), "t": ("exposition", False, False), "x": ("exercise_material", False, False), "y": ("exercise_material", False, False)}


def test_module_order(spark):
    xml = "<c xmlns='n'><content><subcollection><content><module document='a'/><module document='b'/></content></subcollection><module document='z'/></content></c>"
    rows = layout.module_order(spark.createDataFrame([("c", xml), ("e", None)], "collection_id string, xml string")).orderBy("module_order").collect()
    assert [tuple(r) for r in rows] == [("c", 0, "a", 1), ("c", 1, "b", 1), ("c", 2, "z", 0)]


def test_units_keep_offsets(spark):
    """Sentence-like units equal a scan over the characters, with exact offsets."""
    import random

    from pyspark.sql import functions as F

    from quillspan.operators.corpus import evidence_units

    def cut_here(text, i):
        """Where a gap that begins at i ends, if the text is cut there."""
        j = i
        while j < len(text) and text[j] in " \t\n\r\f\v":
            j += 1
        ended = i and (text[i - 1] in ".!?" or i > 1 and text[i - 2] in ".!?" and text[i - 1] in "\"'\u201d\u2019)]")
        if ended and j < len(text) and (text[j] == "(" or "A" <= text[j] <= "Z"):
            return j
        return j if text[i:j].translate({9: None, 32: None, 13: None, 12: None, 11: None}).count("\n") > 1 else None

    def plain(text):
        out, start, i = [], 0, 0
        while i < len(text):
            if text[i] in " \t\n":
                j = i
                while j < len(text) and text[j] in " \t\n":
                    j += 1
                if cut_here(text, i) is not None:
                    out.append((start, i))
                    start = j
                i = j
            else:
                i += 1
        out.append((start, len(text)))
        spans = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in out]
        return [(n, text[a:b], a + 100, b + 100) for n, (a, b) in enumerate((a, b) for a, b in spans if a < b)]

    r = random.Random(1)
    texts = ["  First one. Second (two)!\n\nThird", "", "He said \u201cno.\u201d Then (x.) Y. z! A", "\n\n \n", "a.B c. D"]
    texts += ["".join(r.choice(["A", "b", ". ", ".", "! ", "\n", "\n\n", " ", "(", ") ", "? C", '." D']) for _ in range(r.randrange(30))) for _ in range(200)]
    rows = evidence_units(spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string"), "k", "text", F.lit(100)).collect()
    assert sorted(map(tuple, rows)) == [(k, *u) for k, text in enumerate(texts) for u in plain(text)]


def test_relation_witness(spark):
    from pyspark.sql import functions as F

    from quillspan.functions import witness

    rows = [
        ("MEASURES", "the ammeter", "current (I)", "An ammeter measures the current. Other.", "an ammeter measures the current"),
        ("MEASURES", "ammeter", "current", "An ammeter may measure current.", None),
        ("MEASURES", "current", "ammeter", "An ammeter measures current.", None),
        ("MEASURES", "Ammeter", "the current", "Well; the  ammeter\nis used to measure a current; end", "the ammeter is used to measure a current"),
        ("MEASURES", "ammeter", "current", "Is it that an ammeter measures current? Yes.", None),
        ("MEASURES", "ammeter", "current", "An ammeter measures current. If so, it moves.", None),
        ("USES_QUANTITY", "law", "force", "The law uses the quantity force.", "the law uses the quantity force"),
        ("OTHER", "a", "b", "a controls b", None),
        ("CONTROLS", "", "b", "controls b", None),
        ("CONTROLS", "x y", None, "x y controls b", None),
        ("CONTROLS", "x", "b", None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, s string, o string, t string, want string")
    found = df.select("i", "want", witness.relation_witness(F.col("k"), F.col("s"), F.col("o"), F.col("t")).alias("got")).orderBy("i").collect()
    assert [r.got for r in found] == [r.want for r in found]


def test_names_as_patterns(spark):
    import re

    from pyspark.sql import functions as F

    from quillspan.functions import witness

    names = ["An  Electric charge (Q)", "the a.b", "", None, "(x)"]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(witness.term_pattern(F.col("n"))).collect()]
    python = [re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), f) for f in found]
    assert re.fullmatch(python[0], "the electric charge") and re.fullmatch(python[0], "electric charge") and not re.fullmatch(python[0], "charge")
    assert re.fullmatch(python[1], "a.b") and not re.fullmatch(python[1], "axb")
    assert not any(re.search(p, "x") for p in python[2:])
