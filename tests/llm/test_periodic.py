import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import periodic as p


def plain_runs(words):
    """All runs, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # periods grow: a stretch's first one is its smallest
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def runs_of(words):
    return p.find_runs([[w.encode() for w in words]])[0][1]


def every_run(words):
    """The automaton over the whole list, without the search for stretches."""
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    return p.runs_in(ids, [(0, len(ids))])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_equal_those_of_every_period(parts):
    words = [w for part, times in parts for w in part * times]
    want = plain_runs(words)
    assert runs_of(words) == want
    assert every_run(words) == want


def test_runs_of_words_of_few_letters():
    r = random.Random(3)
    for _ in range(300):
        words = [r.choice("ab") for _ in range(r.randrange(120))]
        assert runs_of(words) == every_run(words) == plain_runs(words)


def test_nested_and_touching_runs():
    inner = list("ab" * 5 + "c")
    words = inner * 4 + list("c" * 7) + list("xyz" * 4) + ["x"]
    assert runs_of(words) == plain_runs(words)
    assert {q for _, _, q in plain_runs(words)} == {1, 2, 3, 11}


def test_texts_of_a_batch_do_not_mix():
    texts = [["a"] * 3, ["a"] * 3, ["a"] * 6, [], list("ab" * 4), ["b"], list("ba" * 3)]
    assert [r for _, r in p.find_runs([[w.encode() for w in t] for t in texts])] == [plain_runs(t) for t in texts]


def test_ends_keep_order_and_neighbours(monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 4)
    r = random.Random(1)
    values = r.sample(range(1000), 300)
    ends = p.Ends(values[0])
    for i, v in enumerate(values[1:], 1):
        have = sorted(values[:i])
        assert ends.add(v) == (max((x for x in have if x < v), default=None), min((x for x in have if x > v), default=None))
    assert list(ends) == sorted(values) and ends.size == 300


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        words = ["w"] * n + [f"x{i % 1000}" for i in range(n)]
        start = time.perf_counter()
        assert runs_of(words) == [(0, n, 1), (n, n, 1000)]
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1


def test_edge_cases_and_contract(spark, edge_docs, edge_rows, no_docs):
    rows = sorted(map(str, (tuple(r) for r in p.document_runs(edge_docs).collect())))
    assert rows == sorted(str(plain(r[0], r[1])) for r in edge_rows)
    assert p.document_runs(no_docs).collect() == []
    many = [(i, " ".join(random.Random(i).choice(["a", "b", "cc\n", "é ", "d\x1cd"]) for _ in range(i % 60)), "s", "n", 1, "p") for i in range(400)]
    docs = spark.createDataFrame(many, "doc_id long, text string, start string, words string, n_runs long, ids string")
    assert sorted((tuple(r) for r in p.document_runs(docs).collect()), key=lambda r: r[0]) == [plain(r[0], r[1]) for r in many]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_the_query_equals_every_period(spark, folder):
    from quillspan.llm.queries import op12_periodic_runs, table

    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    found = sorted((tuple(r) for r in op12_periodic_runs(spark, folder).collect()), key=lambda r: r[0])
    assert found == sorted((plain(*r) for r in rows), key=lambda r: r[0])
    assert sum(r[1] > 0 for r in found) > 10
