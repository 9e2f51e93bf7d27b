import random
import re
import zlib

import numpy as np
import pytest

from quillspan.llm import quality_model as q

from .conftest import DOCS, prose

LABELS = "doc_id long, quality int, toxic int, label string"


def plain_words(text):
    """Buckets of the words of a text, one by one."""
    out = []
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", (text or "").encode()):
        h = sum(int(q._PARTS[min(i, 31) * 256 + b]) for i, b in enumerate(word)) % 2**64
        out.append(h * 0x9E3779B97F4A7C15 % 2**64 >> 50)
    return out


def plain_vectors(texts):
    places, signs = q.index_vectors()
    sums, counts = np.zeros((q.BUCKETS, q.DIMENSIONS)), np.zeros(q.BUCKETS)
    for text in texts:
        words = plain_words(text)
        for i, w in enumerate(words):
            counts[w] += 1
            for j in range(max(0, i - q.WINDOW), min(len(words), i + q.WINDOW + 1)):
                if j != i:
                    for k in range(q.NONZERO):
                        sums[w, places[words[j], k]] += signs[words[j], k]
    length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    return sums / np.where(length > 0, length, 1), q.COMMON / (q.COMMON + counts / max(1, counts.sum()))


def small(rows):
    return [(*r[:1], r[1][:900] if r[1] else r[1], *r[2:]) for r in rows]


def test_words_of_texts():
    texts = ["", "a b", "the&&& été|x", "\n \n", "THE!! x" + "long" * 30, "…—日本"]
    words, count = q.words_of([t.encode() for t in texts])
    assert count.tolist() == [len(plain_words(t)) for t in texts] and sum(count) == len(words)
    assert words.tolist() == [w for t in texts for w in plain_words(t)]
    assert plain_words("THE") != plain_words("the")


def test_word_vectors_cover_every_word_of_every_text(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(q, "AT_ONCE", 300)
    rows = small(edge_rows) + [(100 + i, prose(i, 40), "en", "a", 1, "x") for i in range(30)]
    vectors, weights = q.word_vectors(spark.createDataFrame(rows, DOCS).repartition(3))
    want, want_weights = plain_vectors([r[1] for r in rows])
    assert np.allclose(vectors, want, atol=1e-5) and np.allclose(weights, want_weights, rtol=1e-4)


def test_pooling_is_a_weighted_mean_and_spread(edge_rows):
    texts = [r[1] for r in small(edge_rows)] + ["one", "one one one"]
    vectors, weights = plain_vectors(texts)
    pooled = q.Pooling(vectors.astype(np.float32), weights.astype(np.float32)).pool(texts)
    for row, text in zip(pooled, texts, strict=True):
        words = plain_words(text)
        if not words:
            assert not row.any()
            continue
        w, v = weights[words], vectors[words]
        mean = (w @ v) / w.sum()
        spread = np.sqrt(np.maximum((w @ v**2) / w.sum() - mean**2, 0))
        assert np.allclose(row[: q.DIMENSIONS], mean, atol=1e-4) and np.allclose(row[q.DIMENSIONS :], spread, atol=2e-3)


def test_gradients_equal_differences():
    r = np.random.default_rng(1)
    x, label = r.normal(size=(7, 5)), r.integers(0, 2, 7).astype(float)
    net = q.Network([r.normal(size=(5, 3)), r.normal(size=3), r.normal(size=3), r.normal(size=1)], np.zeros(5), np.ones(5))
    for p, g in zip(net.parameters, net.gradients(x, label), strict=True):
        for at in np.ndindex(p.shape):
            before = p[at]
            p[at] = before + 1e-6
            up = q.cross_entropy(net.logits(x), label)
            p[at] = before - 1e-6
            down = q.cross_entropy(net.logits(x), label)
            p[at] = before
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_temperature_makes_sure_logits_honest():
    r = np.random.default_rng(2)
    logit = r.normal(size=4000) * 2
    label = (r.random(4000) < q.sigmoid(logit)).astype(float)
    for scale in (0.5, 1, 4):
        assert abs(q.best_temperature(logit * scale, label) / scale - 1) < 0.15


def corpus(n, start=0):
    """Clean prose, and the same with signs after every word, in capitals, or one word over and over."""
    r = random.Random(n)
    rows, labels = [], []
    for i in range(start, start + n):
        text, good = prose(1000 + i, r.randrange(30, 200)), i % 3 != 0
        if not good:
            text = [re.sub(r"(\w+)", r"\1&&&", text), text.upper().replace(" ", "!! "), text.split()[0] + f" {text.split()[0]}" * 60][i // 3 % 3]
        rows.append((i, text, "en", "s", 1, "p"))
        labels.append((i, int(good), 0, "l"))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(900)
    taught = [x if zlib.crc32(str(x[0]).encode()) % 5 else (x[0], 1 - x[1], 0, "l") for x in labels]  # labels of the held-out fold are wrong here
    found = {r.doc_id: r for r in q.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(taught, LABELS)).collect()}
    assert len(found) == 900
    held = [(found[i], good) for i, good, *_ in labels if found[i].held_out]
    assert {i for i, r in found.items() if r.held_out} == {i for i in found if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert sum(r.predicted == good for r, good in held) > 0.97 * len(held)


def test_the_sample_is_bounded_and_by_label(spark, monkeypatch):
    monkeypatch.setattr(q, "MOST_LABELLED", 20)
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + rows[:50], DOCS)
    taken = q.sample(docs, spark.createDataFrame(labels + labels[:9] + [(9999, 1, 0, ""), (None, 1, 0, ""), (1, None, 0, "")], LABELS)).collect()
    assert sorted(r.label for r in taken) == [0] * 20 + [1] * 20 and len({r.doc_id for r in taken}) == 40
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 and r.text == dict((x[0], x[1]) for x in rows)[r.doc_id] for r in taken)


def test_edge_cases(spark, edge_docs, no_docs):
    one = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x"), (3, 0, 0, "x"), (4, 0, 0, "x"), (None, 0, 0, "x"), (5, None, 0, "x")], LABELS)
    rows = q.score(edge_docs, one).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert q.score(no_docs, one).count() == 0
    none = q.score(edge_docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    only = q.score(edge_docs, spark.createDataFrame([(i, 0, 0, "") for i in range(9)], LABELS)).collect()
    assert {r.score for r in only} == {0.0}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_the_query_tells_held_out_quality(spark, folder):
    from quillspan.llm.queries import op13_quality_classifier, table

    found = {r.doc_id: r for r in op13_quality_classifier(spark, folder).collect()}
    held = [(found[r.doc_id], r.quality) for r in table(spark, folder, "labels").collect() if found[r.doc_id].held_out]
    assert len(found) == 1000 and sum(r.predicted == quality for r, quality in held) > 0.9 * len(held)
