import random
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import pseudo_lm as m


def grammar(seed, n):
    """Word pairs that always follow each other."""
    r = random.Random(seed)
    return " ".join(f"{x} {x}tail" for x in r.choices("sun moon star sky sea sand wind rain".split(), k=n))


def test_scores_equal_plain_formula():
    r = np.random.default_rng(0)
    net = m.Network.fresh()
    words, around = r.integers(0, m.WORDS, 40), r.integers(0, m.WORDS + 1, (40, 4))
    for w, a, got in zip(words, around, net.log_probability(around, words)):
        h = np.tanh(sum(net.places[k][a[k]] for k in range(4)) + net.bias)
        outer = h @ net.outer + net.outer_bias
        inner = net.inner[w // m.PER_CLASS] @ h + net.inner_bias[w // m.PER_CLASS]
        want = np.log(np.exp(outer)[w // m.PER_CLASS] / np.exp(outer).sum() * np.exp(inner)[w % m.PER_CLASS] / np.exp(inner).sum())
        assert abs(want - got) < 1e-4


def test_gradients():
    r = np.random.default_rng(1)
    net = m.Network.fresh()
    words, around = r.integers(0, m.WORDS, 64), r.integers(0, m.WORDS + 1, (64, 4))
    loss = lambda: -net.log_probability(around, words).mean()
    for p, d in zip(net.arrays(), net.gradients(around, words)):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        was, step = p[at], 1e-2
        p[at] = was + step
        up = loss()
        p[at] = was - step
        down = loss()
        p[at] = was
        assert abs((up - down) / (2 * step) - d[at]) < 0.02 * abs(d[at]) + 1e-5


def test_neighbours_and_masks_cover_every_word():
    v = m.Vocabulary({"a": 0, "b": 1})
    words, around, ends = m.numbered(["a b a", None, "", "b"], v)
    assert words.tolist() == [0, 1, 0, 1] and ends.tolist() == [3, 3, 3, 4]
    assert around.tolist() == [[m.EDGE, m.EDGE, 1, 0], [m.EDGE, 0, 0, m.EDGE], [0, 1, m.EDGE, m.EDGE], [m.EDGE] * 4]
    texts = ["w " * n for n in (1, 5, 64, 200)]
    for text in texts:
        every = [tuple(np.r_[x, y]) for x, y in zip(*m.numbered([text], v)[:2])]
        for turn in range(m.ROUNDS):
            words, around = m.masked(*m.numbered([text], v)[::2], turn)
            assert all(tuple(np.r_[x, y]) in every for x, y in zip(words, around)) and len(words) >= len(every) // m.MASKED


def test_learned_text_scores_higher_than_shuffled(spark, monkeypatch):
    monkeypatch.setattr(m, "BATCH", 256)
    rows = [(i, grammar(i, 200)) for i in range(120)]
    r = random.Random(1)
    shuffled = grammar(5000, 200).split()
    r.shuffle(shuffled)
    rows += [(1000, grammar(5000, 200)), (1001, " ".join(shuffled)), (1002, None), (1003, " "), (1003, " "), (None, "sun")]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in m.score(docs).collect()}
    assert got[1000].score > got[1001].score and got[1000].mean_score > got[1001].mean_score
    assert got[1002].n_words == 0 and got[1002].score == 0 and got[1003].mean_score is None and got[None].n_words == 1
    assert m.score(docs.limit(0)).count() == 0


def test_vocabulary_is_the_top_of_all_texts(spark):
    docs = spark.createDataFrame([("b a a",), ("a c c b",), (None,)], "text string")
    assert dict(m.frequent_words(docs)) == {"a": 0, "b": 1, "c": 2}


def test_rounds_mask_every_place_once():
    words = [f"w{i}" for i in range(200)]
    v = m.Vocabulary({w: i for i, w in enumerate(words)})
    texts = [" ".join(words[:n]) for n in (1, 2, 3, 15, 16, 200)] + [None, ""]
    for ids in (None, list(range(8)), [7, None, 1, 1, 2, 2, 3, 3]):
        seen = np.concatenate([m.masked(*m.numbered(texts, v)[::2], turn, ids)[0] for turn in range(m.ROUNDS)])
        assert sorted(seen.tolist()) == sorted(m.numbered(texts, v)[0].tolist())
    copies = [m.masked(*m.numbered(["w1 w2"], v)[::2], 0, [i])[0].tolist() for i in range(2)]
    assert sorted(copies) == [[1], [2]]


def test_words_of_a_bucket_are_told_apart_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(m, "FREQUENT", m.WORDS - 1)  # one bucket
    monkeypatch.setattr(m, "WORDS", m.WORDS)
    known = {f"v{i}": i for i in range(3)}
    counts = spark.createDataFrame([("v0", 9), ("v1", 9), ("v2", 9), ("often", 6), ("été", 3), ("never", 1)], "word string, n long")
    got = {r.word: r.share for r in m.shares(counts, m.Vocabulary(known)).collect()}
    assert got.keys() == {"often", "été", "never"}
    for word, n in (("often", 6), ("été", 3), ("never", 1)):
        assert abs(got[word] - np.log(n / 10)) < 1e-9


def test_scores_follow_the_counts_of_rare_words(spark, monkeypatch):
    monkeypatch.setattr(m, "frequent_words", lambda docs, counts=None: m.Vocabulary({"a": 0, "b": 1}))
    by_bucket = {}
    for i in range(5000):
        by_bucket.setdefault(m.bucket_of(f"é{i}"), []).append(f"é{i}")
    often, seldom = next(x for x in by_bucket.values() if len(x) > 1)[:2]
    rows = [(1, f"a {often} b"), (2, f"a {seldom} b"), (2, f"a {seldom} b"), (None, "b a"), (4, None)] + [(9, f"{often} " * 20)]
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    one, two = (sorted({round(r.score, 6) for r in got if r.doc_id == i}) for i in (1, 2))
    assert len(two) == 1 and abs(one[0] - two[0] - np.log(21 / 2)) < 1e-4
    assert {r.n_words for r in got if r.doc_id is None} == {2} and [r.score for r in got if r.doc_id == 4] == [0]


@pytest.mark.parametrize("near", [0, 3, 1 << 17])
def test_query_equals_a_plain_computation(spark, edge_docs, monkeypatch, near):
    """Every score from its words one by one, with plain counts; whether shares are sent or joined makes no difference."""
    net = m.Network.fresh(5)
    vocabulary = {w: i for i, w in enumerate("word thea ofb".split())}
    monkeypatch.setattr(m, "NEAR", near)
    monkeypatch.setattr(m, "frequent_words", lambda docs, counts=None: m.Vocabulary(vocabulary))
    monkeypatch.setattr(m, "train", lambda encoded: net)
    rows = edge_docs.select("doc_id", "text").collect()
    counts = Counter(w for r in rows for w in (r.text or "").lower().split())
    buckets = Counter()
    for w, n in counts.items():
        if w not in vocabulary:
            buckets[m.bucket_of(w)] += n

    def plain(text):
        words = (text or "").lower().split()
        numbers = [vocabulary.get(w, m.bucket_of(w)) for w in words]
        around = [m.EDGE] * 2 + numbers + [m.EDGE] * 2
        total = 0.0
        for i, (w, number) in enumerate(zip(words, numbers)):
            h = np.tanh(sum(net.places[k][around[i + 2 + place]] for k, place in enumerate(m.PLACES)) + net.bias)
            outer, inner = h @ net.outer + net.outer_bias, net.inner[number // m.PER_CLASS] @ h + net.inner_bias[number // m.PER_CLASS]
            total += outer[number // m.PER_CLASS] - np.log(np.exp(outer).sum()) + inner[number % m.PER_CLASS] - np.log(np.exp(inner).sum())
            total += 0 if w in vocabulary else np.log(counts[w] / buckets[number])
        return len(words), total

    got = sorted((str(r.doc_id), r.n_words, r.score) for r in m.score(edge_docs).collect())
    want = sorted((str(r.doc_id), *plain(r.text)) for r in rows)
    assert len(got) == len(want)
    for (a, n, x), (b, k, y) in zip(got, want):
        assert (a, n) == (b, k) and abs(x - y) < 1e-3 * max(1, abs(y))


def test_weights_are_averaged_alike_by_a_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, grammar(i, 30)) for i in range(64)], "doc_id long, text string").repartition(16)
    v = m.Vocabulary({"sun": 0, "moon": 1})
    docs = m.encode(docs, v, {}).repartition(16, "doc_id").sortWithinPartitions("doc_id")
    flat = m.one_round(docs, m.Network.fresh(), 0).pack()
    monkeypatch.setattr(m, "BRANCHES", 2)
    monkeypatch.setattr(m, "SUMS", 1)
    assert np.abs(m.one_round(docs, m.Network.fresh(), 0).pack() - flat).max() < 1e-5


def test_encoded_texts_are_their_numbers(spark, edge_docs):
    v, near = m.Vocabulary({"word": 0, "thea": 1}), {"été": -0.5, "ofb": -0.25}
    rows = m.encode(edge_docs, v, near).collect()
    texts = {str(r.doc_id): r.text for r in edge_docs.collect()}
    assert len(rows) == 11 and len({r.row for r in rows}) == 11
    for r in rows:
        own = (texts[str(r.doc_id)] or "").lower().split()
        assert np.frombuffer(r.numbers, "<u2").tolist() == [v.get(w, m.bucket_of(w)) for w in own]
        assert abs(r.shares - sum(near.get(w, 0) for w in own)) < 1e-9
        assert dict(zip(r.rare, r.times)) == Counter(w for w in own if w not in v and w not in near)


def test_a_batch_costs_few_passes(monkeypatch):
    """The softmax, or its logarithm, is taken for all words of a batch at once, not class by class."""
    calls = []
    for name in ("_softmax", "_log_sum"):
        monkeypatch.setattr(m, name, lambda x, tame, f=getattr(m, name): calls.append(len(x)) or f(x, tame))
    draw = np.random.default_rng(1)
    words, around = draw.integers(0, m.WORDS, 500), draw.integers(0, m.WORDS, (500, 4))
    net = m.Network.fresh()
    net.gradients(around, words)
    net.log_probability(around, words)
    assert calls == [500] * 4
