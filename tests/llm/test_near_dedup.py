import random
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import near_dedup as d
from quillspan.llm.components import components

from .conftest import DOCS, prose


def bag(text):
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similar(a, b):
    a, b = bag(a), bag(b)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def changed(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for i in r.sample(range(len(w)), n):
        w[i] = f"other{seed}x{i}"
    return " ".join(w)


def brute(rows):
    texts = [(i, t) for i, t in rows if t and t.split()]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(texts):
        for j, b in texts[k + 1 :]:
            if similar(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) if i in root else i for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    out = [prose(k, 150 + k) for k in range(12)]
    for k in range(4):
        out += [changed(out[k], n, 100 + k * 9 + n) for n in (1, 2, 3, 5, 8, 12)]
    out += [out[0], out[0], "", "two words", "two words", "tiny", prose(50, 40) + " " + "again and again we say so " * 20, prose(50, 40) + " " + "again and again we say so " * 23]
    return list(enumerate(out))


def test_classes_equal_brute_force(spark, rows):
    got = {r.doc_id: r.class_id for r in d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("verify, block, chunks", [(3, 3, 25), (2, 2, 0), (5, 1000, 1), (1000, 2, 25)])
def test_classes_are_the_same_however_the_work_is_dealt(spark, rows, monkeypatch, verify, block, chunks):
    monkeypatch.setattr(d, "VERIFY", verify)
    monkeypatch.setattr(d, "BLOCK", block)
    monkeypatch.setattr(d, "MOST_CHUNKS", chunks)
    got = {r.doc_id: r.class_id for r in d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def template(k, tail, own=60):
    """Texts of one template: 120 words that all have, and words of their own."""
    return prose(77, 120) + " " + " ".join(f"own{k}x{i}" for i in range(own)) + tail


@pytest.mark.parametrize("chunks, runs", [(25, 4_000_000), (1, 4_000_000), (1, 600)])
def test_a_large_cluster_of_many_classes(spark, monkeypatch, chunks, runs):
    """Texts that have two thirds of their words from one template aren't linked by it; copies of each are, whatever the dealing."""
    monkeypatch.setattr(d, "VERIFY", 8)
    monkeypatch.setattr(d, "BLOCK", 16)
    monkeypatch.setattr(d, "MOST_CHUNKS", chunks)
    monkeypatch.setattr(d, "MOST_RUNS", runs)
    asked = []
    across = d._across
    monkeypatch.setattr(d, "_across", lambda rows, texts: asked.append((rows.count(), (units := across(rows, texts)).count(), units.select("unit").distinct().count())) or units)
    rows = list(enumerate([template(k, t) for k in range(80) for t in ("", f" and{k}", f" more words{k} here")]))
    want = brute(rows)
    assert len(set(want.values())) == 80
    got = {r.doc_id: r.class_id for r in d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    (texts, met, units), = asked
    assert texts > 200 and (chunks > 1 or met <= 2 * texts)


def test_texts_at_the_threshold_share_a_rare_run():
    """For any frequencies, two texts that reach the threshold have one of the items in common by which large clusters are split."""
    r = random.Random(11)
    some = 0
    for k in range(300):
        a = [r.choice("abcdefghij") for _ in range(r.randrange(5, 60))] if k % 3 else prose(k, r.randrange(1, 90)).split()
        b = list(a)
        for _ in range(r.randrange(0, 3)):
            b[r.randrange(len(b))] = r.choice("klm")
        b += [r.choice("abc") for _ in range(r.randrange(0, 4))]
        a, b = " ".join(a), " ".join(b)
        frequency = np.random.default_rng(k).integers(0, 4, d.COUNTERS)
        found, ends = d.rare_items([a.encode(), b"", b.encode()], frequency)
        assert ends[0] == ends[1]
        if similar(a, b) >= 0.8:
            some += 1
            assert set(found[: ends[0]].tolist()) & set(found[ends[1] :].tolist())
    assert some > 100


def test_items_are_the_bag_as_a_set():
    a, b = "x y z v w " * 6, "x y z v w " * 4 + "other words at the end"
    found, ends = d.items([a.encode(), b.encode()])
    one, two = set(found[: ends[0]].tolist()), set(found[ends[0] :].tolist())
    assert len(one) == sum(bag(a).values()) and len(two) == sum(bag(b).values()) and len(one & two) == sum((bag(a) & bag(b)).values())


def test_recall_of_links_at_and_above_the_threshold(spark):
    """Pairs of every similarity from 0.8 up: at least 0.9 of the links that brute force finds are found."""
    made = []
    for k in range(60):
        base = prose(1000 + k, 200)
        made += [base, changed(base, 1 + k % 5, 5000 + k)]
    rows = list(enumerate(made))
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in d.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked) and all(got[i] == i for i in want if want[i] == i)


def test_clashing_names_are_kept(spark, edge_rows):
    names = ["__tid", "__rk", "text_tid", "text_rk", "root", "bands"]
    docs = spark.createDataFrame([(*r, *names) for r in edge_rows], DOCS + "".join(f", {n} string" for n in names))
    kept = d.keep_one(docs)
    assert kept.columns == docs.columns and all(tuple(r)[-len(names) :] == tuple(names) for r in kept.collect()) and kept.count() == 8


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(80):
        keys = np.sort(r.integers(0, 2**63, 40).astype(np.uint64))
        a = r.integers(0, 9, 40)
        b = np.maximum(0, a + r.integers(-2, 3, 40))
        one, two = a > 0, b > 0
        s = d.signatures(np.r_[keys[one], keys[two]], np.r_[a[one], b[two]], np.array([one.sum(), one.sum() + two.sum()]))
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and 0.02 < np.std(errors) < 0.06


def test_bags_equal_plain_counts(edge_rows):
    texts = [(r[1] or "") for r in edge_rows] + ["a b c d e a b c d e a b c d e", "x"]
    _, counts, ends = d.bags([t.encode() for t in texts])
    for text, start, end in zip(texts, np.r_[0, ends[:-1]], ends):
        assert sorted(counts[start:end].tolist()) == (sorted(bag(text).values()) if text.encode().split() else [])


def test_edge_cases(edge_docs, no_docs):
    rows = d.near_duplicates(edge_docs).collect()
    found = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == 11 and found[2] == found[6] == 1 and found[3] == 3 and found[4] == 4 and found[7] == 7 and found[None] is None
    kept = d.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "7", "8", "9", "None"])
    assert d.near_duplicates(no_docs).count() == 0 and d.keep_one(no_docs).count() == 0
    assert DOCS


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_stars_need_no_round(spark, monkeypatch):
    from quillspan.llm import components as c

    written = []
    monkeypatch.setattr(c, "materialize", lambda df, tag, f=c.materialize: written.append(tag) or f(df, tag))
    stars = spark.createDataFrame([(5 * (i // 5), i) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in c.components(stars).collect()} == {(i, 5 * (i // 5)) for i in range(40) if i % 5}
    assert written == ["edges", "least"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 39), (39, 41), (41, 38)], "a long, b long")
    assert {tuple(r) for r in c.components(chain).collect()} == {(i, 0) for i in range(1, 31)} | {(i, 38) for i in (39, 40, 41)}
