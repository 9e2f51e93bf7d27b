import re

from quillspan.llm import license_scan as s


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text):
    w = words(text)
    found = [(i, label) for p, label in s.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "Under the MIT-License. under THE mit license, CC BY-NC x cc by nc", "Apache License, Version 2.0", "under the under the mit license", None, "", "ünder the mit license é",
    "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and the associated documentation files",
    "this work is licensed under the GNU general public license version 3", "under the mit", "a b", "under mit the license " * 50,
]


def test_base_places_equal_a_plain_search(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, label string")
    got = {r.doc_id: r for r in s.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == places(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_spans_with_changed_words_are_found(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in s.scan(docs).collect()}
    assert got[6].labels == "mit" and 0.6 < got[6].score < 1 and got[6].n_base == 0
    assert got[7].labels == "gpl-3" and got[7].score == 1
    assert got[8].labels == "" and got[10].labels == ""


def test_edge_cases(edge_docs, no_docs):
    rows = s.scan(edge_docs).collect()
    assert len(rows) == 11 and sum(r.doc_id == 1 for r in rows) == 2
    assert s.scan(no_docs).count() == 0


def test_time_is_linear_in_the_length_of_a_text(spark):
    import time

    def seconds(n):
        text = " ".join(f"w{i % 997}" for i in range(n)) + " under the MIT license"
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        row = s.scan(docs).collect()[0]
        assert (row.n_words, row.first_word) == (n + 4, n)
        return time.perf_counter() - start

    seconds(1000)
    short, long = seconds(100_000), seconds(500_000)
    assert long < 5 * short + 10
