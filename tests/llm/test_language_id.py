import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillspan.llm import language_id as g

WORDS = {"xx": "blom grath snuv drelk fron".split(), "yy": "aliato enora usita oremi".split(), "zz": "ščur ñaña éloi çuxu".split()}


def sample(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(WORDS[lang])[:2] for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sample(lang, 5 + i % 90, i), lang if i % 9 else None, "s", 0.5) for i in range(300) for lang in [list(WORDS)[i % 3]]]
    rows += [(1000, None, "xx", None, None), (1001, "... 123", "yy", "s", 1.0), (1002, "", None, "s", 1.0), (None, rows[0][1], None, "s", 1.0), (1003, sample("xx", 9000, 1), None, "s", 1.0), (1003, sample("xx", 9000, 1), None, "s", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy_and_edge_cases(docs):
    rows = g.identify(docs).collect()
    assert len(rows) == 306
    truth = {i: list(WORDS)[i % 3] for i in range(300)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    found = {r.doc_id: r for r in rows}
    assert found[1000].lang_pred == found[1001].lang_pred == found[1002].lang_pred == "und" and found[1001].score == 0
    assert found[1003].lang_pred == "xx" and found[None].lang_pred == "xx"
    assert {r.held_out for r in rows if r.doc_id == 5} == {__import__("zlib").crc32(b"5") % 4 == 2}
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_labelled_or_empty(spark, docs):
    assert {r.lang_pred for r in g.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert g.identify(docs.limit(0)).count() == 0 and g.language_filter(docs.limit(0)).columns == docs.columns


def test_sample_is_bounded(docs):
    windows, target, labels = g.training_windows(docs, per_language=7)
    assert labels == sorted(WORDS) and len(windows) <= 3 * 7 * g.WINDOWS


def test_filter_keeps_prose(docs):
    kept = {r.doc_id for r in g.language_filter(docs).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept & set(range(300))) > 295


def test_lookup_and_plain_convolution_agree():
    net = g.Network.fresh(["a", "b", "c"])
    windows = np.random.default_rng(0).integers(0, 256, (70, g.LENGTH)).astype(np.uint8)
    plain = g.softmax(net.pooled(windows)[1] @ net.out + net.out_bias)
    assert np.abs(net.predict(windows) - plain).max() < 1e-5


def test_gradients():
    net = g.Network.fresh(["a", "b", "c"])
    windows, target = np.random.default_rng(1).integers(0, 256, (6, g.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -np.log(g.softmax(net.pooled(windows)[1].astype(float) @ net.out + net.out_bias)[np.arange(6), target]).mean()
    for p, d in zip(net.parameters(), net.gradients(windows, target)):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        was, step = p[at], 1e-3
        p[at] = was + step
        up = loss()
        p[at] = was - step
        down = loss()
        p[at] = was
        assert abs((up - down) / (2 * step) - d[at]) < 0.1 * abs(d[at]) + 1e-4


def test_query_equals_a_plain_network(spark, docs, monkeypatch):
    """Every prediction from its windows one by one: embedding, convolutions as loops, pooling and softmax."""
    net = g.Network.fresh(["a", "b"], seed=3)
    monkeypatch.setattr(g, "train", lambda docs: net)
    rows = docs.limit(20).collect() + docs.where("doc_id >= 1000").collect()

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total, weights = np.zeros(2), 0
        for at in range(0, len(data), g.LENGTH):
            window = data[at : at + g.LENGTH].ljust(g.LENGTH, b"\0")
            pooled = []
            for width, filters, bias in zip(g.WIDTHS, net.filters, net.biases):
                answers = [np.concatenate([net.embedding[b] for b in window[i : i + width]]) @ filters + bias for i in range(g.LENGTH - width + 1)]
                pooled.append(np.maximum(np.max(answers, axis=0), 0))
            e = np.concatenate(pooled) @ net.out + net.out_bias
            e = np.exp(e - e.max())
            n = min(g.LENGTH, len(data) - at)
            total, weights = total + n * e / e.sum(), weights + n
        return net.labels[int(total.argmax())], float(total.max() / weights)

    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in g.identify(spark.createDataFrame(rows, docs.schema)).collect())
    want = sorted((str(r.doc_id), *plain(r.text)) for r in rows)
    assert len(got) == len(want)
    for (a, lang, x), (b, wanted, y) in zip(got, want):
        assert (a, lang) == (b, wanted) and abs(x - y) < 1e-4


def test_a_dirty_label_column_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(g, "MOST_LANGUAGES", 2)
    assert len(g.training_windows(docs, per_language=5)[2]) == 2


@pytest.mark.parametrize("copies", [1, 2500])
def test_few_texts_with_many_copies_teach_every_language(spark, copies):
    """Labels whose rows are copies of few texts are learned, inside the query, and told apart."""
    import random

    r = random.Random(4)
    texts = [(lang, " ".join(r.choice(WORDS[lang]) for _ in range(60))) for lang in sorted(WORDS) for _ in range(4)]
    rows = [(i, text, lang) for i, (lang, text) in enumerate(texts * max(copies, 8))]
    found = g.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)).collect()
    assert len(found) == len(rows)
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in found) > 0.99 * len(rows)


def test_filter_keeps_columns_with_clashing_names(spark, docs):
    names = ["h", "rank", "windows", "score", "lang_pred", "held_out", "count"]
    more = docs.limit(40).select("*", *(F.lit(f"v{n}").alias(n) for n in names if n not in docs.columns))
    kept = g.language_filter(more)
    assert kept.columns == more.columns and all(r.rank == "vrank" and r.windows == "vwindows" for r in kept.collect())
