"""Equation regions, their context, balanced calls and followed references against plain sweeps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import balanced, references, regions

SPAN = "page long, n long, left double, top double, width double, height double, text string"


def layout(seed, pages=6):
    """Pages of words set with uneven gaps and heights, some of them twice."""
    r = random.Random(seed)
    rows = []
    for page in range(pages):
        n = 0
        for line in range(r.randrange(1, 12)):
            x, y = r.randrange(0, 30), 14.0 * line + r.choice([0, 0, 0.5])
            while x < 380:
                text = r.choice(["=", "a =", "F", "m a", "12", "x^2", "energy", "the", "of", "speed =", "take 5 m = 10 m / 2 s now", "Example 2", "+", "Solution", "", "b"])
                rows.append((page, n, float(x), y, 5.0 * max(1, len(text)), float(r.choice([8, 10, 10, 12])), text))
                if r.random() < 0.05:
                    n += 1
                    rows.append((*rows[-1][:1], n, *rows[-1][2:]))
                x += 5 * max(1, len(text)) + r.choice([0, 2, 3, 4, 9, 60])
                n += 1
    return rows


def is_math(text):
    text = text.strip()
    return 0 < len(text) <= 80 and not re.search("[A-Za-z]{4}", text) and bool(re.fullmatch(f"[{regions.SIGNS}]+", text))


def sweep(rows, width, height):
    """Regions of one page: every equals sign in turn, widened until nothing is added."""
    spans = [(left, top, left + w, top + h, text) for _, _, left, top, w, h, text in rows]
    found, seen = [], []
    for n, (x0, y0, x1, y1, text) in enumerate(spans):
        if "=" not in text or not (is_math(text) or re.search(regions.INLINE.replace("(?U)", ""), text)):
            continue
        near = [s for s in spans if is_math(s[4]) and s[0] <= x1 + 28 and s[2] >= x0 - 28 and s[1] <= y1 + 9 and s[3] >= y0 - 9] + [spans[n]]
        left, up = max(0, min(s[0] for s in near) - 1), max(0, min(s[1] for s in near) - 1)
        right, down = min(width, max(s[2] for s in near) + 1), min(height, max(s[3] for s in near) + 1)
        changed = True
        while changed:
            changed = False
            for s in spans:
                if up <= s[1] and s[3] <= down and s[0] <= right + 3 and s[2] >= left - 3 and (s[0] < left or s[2] > right):
                    left, right, changed = min(left, s[0]), max(right, s[2]), True
        held = {(s[0], s[1], s[4]) for s in spans if left <= s[0] and s[2] <= right and up <= s[1] and s[3] <= down}
        if held not in seen:
            seen.append(held)
            found.append((left, up, right, down))
    return found


def above(rows, box):
    spans = sorted({(top, left, n, left + w, top + h, text) for _, n, left, top, w, h, text in rows})
    once = {}
    for s in spans:
        key = (s[0], s[1], s[3], s[4], s[5])
        once[key] = min(once.get(key, s[2]), s[2])
    spans = [(top, left, n, right, down, text) for (top, left, right, down, text), n in once.items()]
    x0, y0, x1, _ = box
    taken = [s for s in spans if y0 - 45 <= s[0] and s[4] <= y0 and s[1] < x1 + 250 and s[3] > x0 - 30]
    for s in taken:
        taken += [v for v in spans if v not in taken and abs(v[0] - s[0]) <= 3 and abs(v[1] - s[3]) <= 3 and v[4] <= y0]
    return " ".join(s[5] for s in sorted(taken, key=lambda s: (s[0], s[1], s[2])))


@pytest.mark.parametrize("seed", range(3))
def test_regions_equal_a_sweep(spark, seed):
    rows = layout(seed)
    spans = spark.createDataFrame(rows, SPAN).repartition(3)
    pages = spark.createDataFrame([(p, 400.0, 170.0) for p in range(7)], "page long, page_width double, page_height double")
    found = regions.equation_regions(spans, pages)
    boxes = {(r.page, r.region): (r.x0, r.y0, r.x1, r.y1) for r in found.collect()}
    want = {(p, i): b for p in range(6) for i, b in enumerate(sweep([r for r in rows if r[0] == p], 400.0, 170.0))}
    assert boxes == want and len(want) > 10
    for c in regions.candidates(spans, found).collect():
        own, box = [r for r in rows if r[0] == c.page], want[c.page, c.region]
        tops = [(r[3], r[1], r[6]) for r in own if re.match(r"(?i)\s*(?:Example\s+\d|Solution\b)", r[6])]
        assert c.role == ("example_or_later" if tops and box[3] >= min(tops)[0] else "unclassified_source")
        assert c.heading == max([t for t in tops if t[0] <= box[1]], default=(0, 0, None))[2]
        held = [r[6] for r in own if box[0] <= r[2] and r[2] + r[4] <= box[2] and box[1] <= r[3] and r[3] + r[5] <= box[3]]
        assert c.symbols == sorted({s for t in held for s in re.findall("(?<![A-Za-z])[A-Za-z](?![A-Za-z])", t)})
        assert c.preceding == above(own, box)


def test_no_spans(spark):
    spans = spark.createDataFrame([], SPAN)
    pages = spark.createDataFrame([], "page long, page_width double, page_height double")
    found = regions.equation_regions(spans, pages)
    assert found.count() == 0 and regions.candidates(spans, found).count() == 0


def plain_calls(text):
    out = []
    for m in re.finditer(r"\b(?:sqrt|root|ln|log|sin|cos|tan|exp|[A-Za-z])\s*\(", text or ""):
        depth = 0
        for end in range(m.end() - 1, len(text)):
            depth += (text[end] == "(") - (text[end] == ")")
            if depth == 0:
                out.append((m.start(), end + 1))
                break
    return out


def test_calls_equal_a_scan(spark):
    r = random.Random(2)
    texts = [None, "", "no", "f(", "f)", "f(x)", "sin (x(y) + (z)) f((", ")))f(x)(((", "éf(x) _g(x) 2h(x) (k)(x)", "tan\n (a) arctan(b)  x(1)"]
    texts += ["".join(r.choice(["f", "(", ")", "sin", " ", "ab", "(", ")", "x", "ñ"]) for _ in range(r.randrange(80))) for _ in range(300)]
    texts.append("f(" * 3000 + "x" + ")" * 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    found = balanced.calls(docs, "id", "t")
    rows = found.collect()
    assert sorted((x.id, x.start, x.end) for x in rows) == sorted((i, *c) for i, t in enumerate(texts) for c in plain_calls(t))
    lists = {x.id: x.expressions for x in balanced.expressions(docs, "id", "t", found.where("id < 200")).collect()}
    assert lists == {i: sorted({re.sub(r"\s+", "", t[a:b]) for a, b in plain_calls(t)}) for i, t in enumerate(texts[:200]) if plain_calls(t)}


def test_brackets_are_dealt_by_their_number(spark, monkeypatch):
    docs = spark.range(60).select("id", F.repeat(F.lit("f(x) "), F.col("id").cast("int")).alias("t"))
    for marks, parts in ((1 << 20, 4), (100, 36)):  # 3540 brackets in all
        monkeypatch.setattr(balanced, "MARKS", marks, raising=False)
        found = balanced.calls(docs, "id", "t")
        assert found.count() == 1770 and found.rdd.getNumPartitions() == parts


def plain_follow(texts, ranking, first, capacity):
    ids = ranking[:first][:capacity]
    for i in ids:
        for ref in re.findall(r"see (\w+)", texts[i]):
            if ref in texts and ref not in ids and len(ids) < capacity:
                ids.append(ref)
    return ids + [i for i in ranking if i not in ids][: capacity - len(ids)]


@pytest.mark.parametrize("first, capacity", [(2, 4), (1, 7), (3, 2)])
def test_references_are_followed_like_a_growing_list(spark, first, capacity):
    r = random.Random(first)
    cases = {}
    for c in range(40):
        names = [f"p{i}" for i in range(r.randrange(1, 10))]
        texts = {p: " ".join(f"see {r.choice([*names, 'p77'])}" for _ in range(r.randrange(4))) for p in names}
        cases[c] = texts, r.sample(names, len(names))
    cases[99] = {"a": "see b see a", "b": "see a"}, ["a", "b"]
    passages = spark.createDataFrame([(c, i, t) for c, (texts, _) in cases.items() for i, t in texts.items()], "case long, id string, text string")
    ranking = spark.createDataFrame([(c, i, n) for c, (_, order) in cases.items() for n, i in enumerate(order)] + [(99, "gone", -1)], "case long, id string, rank long")
    chosen = references.follow(passages, ranking, r"see (\w+)", first, capacity)
    found = {}
    for x in sorted(chosen.collect(), key=lambda x: (x.case, x.place)):
        found.setdefault(x.case, []).append(x.id)
    assert found == {c: plain_follow(texts, order, first, capacity) for c, (texts, order) in cases.items()}
    whole = {x.case: x.complete for x in references.complete(passages, chosen).collect()}
    assert whole == {c: len(found[c]) == len(texts) for c, (texts, _) in cases.items()}


def test_regions_shuffle_nothing_but_spans_by_page(spark):
    spans = spark.createDataFrame(layout(5), SPAN)
    pages = spark.createDataFrame([(p, 400.0, 170.0) for p in range(7)], "page long, page_width double, page_height double").repartition(5, "page")
    found = regions.equation_regions(spans.repartition(5, "page"), pages, dealt=True)
    assert "ENSURE_REQUIREMENTS" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(regions.equation_regions(spans, pages).collect())


def test_what_goes_on_is_read_off_lines_without_rounds(spark, monkeypatch):
    """Lines of their own, with words that go on far beyond a region: only lines are written, and nothing is followed."""
    r = random.Random(9)
    rows, n = [], 0
    for page in range(3):
        for line in range(9):
            x = 0.0
            while x < 780:
                text = "=" if x < 60 and r.random() < 0.3 else r.choice(["a", "word", "to", "x", "nav"])
                rows.append((page, n, x, 14.0 * line, 8.0 * len(text), 10.0, text))
                n, x = n + 1, x + 8.0 * len(text) + r.choice([0, 0, 0, 1, 3, 4, 8])
    made, keep = [], regions.Rounds.keep
    monkeypatch.setattr(regions.Rounds, "keep", lambda self, name, make: (made.append(name), keep(self, name, make))[1])
    spans = spark.createDataFrame(rows, SPAN)
    pages = spark.createDataFrame([(p, 800.0, 200.0) for p in range(3)], "page long, page_width double, page_height double")
    found = regions.equation_regions(spans, pages)
    boxes = {(b.page, b.region): (b.x0, b.y0, b.x1, b.y1) for b in found.collect()}
    got = {(c.page, c.region): c.preceding for c in regions.candidates(spans, found, "^nav$").collect()}
    assert made == ["lines", "lines"]
    assert got == {k: above([s for s in rows if s[0] == k[0]], b) for k, b in boxes.items()} and len(got) > 10
    on = [sum(s[2] >= b[2] + 250 for s in rows if s[0] == k[0] and b[1] - 45 <= s[3] <= b[1] - 10) for k, b in boxes.items()]
    assert max(on) > 0  # there is text beyond the edge


def test_equal_spans_count_once(spark):
    """Of equal boxes with equal texts the first is taken, also with another span between them."""
    rows = [(1, 0, 0.0, 0.0, 8.0, 10.0, "b"), (1, 1, 0.0, 0.0, 9.0, 10.0, "c"), (1, 2, 0.0, 0.0, 8.0, 10.0, "b"), (1, 3, 20.0, 0.0, 8.0, 10.0, "b")]
    lines = regions.page_lines(spark.createDataFrame(rows, SPAN)).collect()
    assert [(line.alone, [(s.n, s.text) for s in line.spans]) for line in lines] == [(True, [(0, "b"), (1, "c"), (3, "b")])]
