import re

import pytest

from quillspan.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 2000 else None
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, inside


def test_measures_equal_a_plain_count(edge_rows):
    texts = [r[1] for r in edge_rows if r[0] != 5] + ["a b c a b c a", "x\nx\n \n \ny\nx", "# <b>|", "a b"]
    for text in texts:
        n, chars, symbols, dup, inside = plain(text)
        got = q.measure(text)
        assert got[:4] == (n, chars, symbols, dup)
        assert got[4] == len(inside)
        assert got[5] == (n < 50 or 100 * len(inside) > 50 * n)


def test_edge_cases(edge_docs, no_docs):
    rows = q.quality(edge_docs).collect()
    assert len(rows) == 11 and sum(r.doc_id == 1 for r in rows) == 2
    assert {r.doc_id: r.kept for r in rows}[4] is False
    assert q.quality(no_docs).count() == 0 and q.quality_filter(no_docs).columns == no_docs.columns


def plain_verdicts(rows):
    """Watched rules and rejection of each host, from lists of (host, bits)."""
    out = {}
    hosts = sorted({h for h, _ in rows if h is not None})
    for rule in range(len(q.RULES)):
        own = {h: [bits >> rule & 1 for x, bits in rows if x == h] for h in hosts}
        n_all, p = sum(map(len, own.values())), sum(map(sum, own.values())) / sum(map(len, own.values()))
        k = None
        if 0 < p < 1 and len(hosts) > 1:
            spread = sum(len(x) * (sum(x) / len(x) - p) ** 2 for x in own.values())
            rho = (spread - p * (1 - p) * (len(hosts) - 1)) / (p * (1 - p) * (n_all - sum(len(x) ** 2 for x in own.values()) / n_all - len(hosts) + 1))
            k = max(q.WEAKEST, 1 / rho - 1) if rho > 0 else None
        for h, x in own.items():
            watched, rejected = out.setdefault(h, (0, False))
            if k is not None:
                rate = (sum(x) + p * k) / (len(x) + k)
                deviation = (rate * (1 - rate) / (len(x) + k + 1)) ** 0.5
                out[h] = watched + (rate - q.SURE * deviation > q.WATCHED * p) * (1 << rule), rejected or rule == 0 and rate - q.DEVIATIONS * deviation > q.REJECTED
    return out


def test_hosts_shrink_and_reject(spark):
    rows = [("good", i % 50 == 0) for i in range(500)] + [("bad", i % 20 != 0) for i in range(400)] + [("small", True)] * 2 + [(None, True)] * 3
    rows = [(h, int(f) + (2 if i % (3 if h == "good" else 9) == 0 else 0) + (4 if i % 7 == 0 else 0)) for i, (h, f) in enumerate(rows)]
    found = {r.host: (r.watched, r.rejected) for r in q.host_verdicts(spark.createDataFrame(rows, "host string, failed long")).collect()}
    assert found == plain_verdicts(rows)
    assert found["bad"][1] and not found["good"][1] and not found["small"][1] and None not in found
    assert found["good"][0] & 2 and not found["bad"][0] & 2


def test_verdicts_reach_the_documents(spark, monkeypatch):
    from quillspan.llm import common

    from .conftest import prose

    long, line = prose(3, 90), "one line here\n"
    rows = [(i, ("few words" if i % 20 else long), "bad") for i in range(100)] + [(200 + i, long + "\n" + (line * 3 if i < 60 else "x"), "lines") for i in range(100)]
    rows += [(400 + i, long + "\n" + (line * 3 if i < 10 else "x"), f"fine{i % 3}") for i in range(300)] + [(900, long + "\n" + line * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (20_000, 2):  # hosts by a broadcast, and by both joins
        monkeypatch.setattr(common, "HOT_KEYS", most)
        found = {r.doc_id: r for r in q.quality(docs).collect()}
        bits = {i: sum(1 << k for k, (name, _) in enumerate(q.RULES) if name in found[i].failed_rules.split(",")) for i, _, _ in rows}
        verdicts = plain_verdicts([(h, bits[i]) for i, _, h in rows])
        for i, _, h in rows:
            watched, rejected = verdicts.get(h, (0, False))
            assert found[i].host_rejected == rejected and found[i].kept == (not bits[i] & 1 and not rejected and not bits[i] & watched)
        assert found[0].host_rejected and not found[0].kept and not found[200].kept and found[260].kept and found[400].kept and found[900].kept
        assert {r.doc_id for r in q.quality_filter(docs).collect()} == {i for i, r in found.items() if r.kept}


@pytest.mark.parametrize("most", [20_000, 1])
def test_clashing_names_are_kept(spark, edge_rows, monkeypatch, most):
    from quillspan.llm import common

    names = ["__host", "host_of_doc", "failed_bits", "host_rejected", "n", "rule", "__tid", "__rk", "__hot", "__key", "__cold", "__found", "hot_values", "own_key", "cold_values", "found_values"]
    docs = spark.createDataFrame([(*r, *names) for r in edge_rows], "doc_id long, text string, lang string, source string, n_words long, path string, " + ", ".join(f"{n} string" for n in names))
    monkeypatch.setattr(common, "HOT_KEYS", most)
    kept = q.quality_filter(docs)
    assert kept.columns == docs.columns and all(tuple(r)[-len(names) :] == tuple(names) for r in kept.collect()) and kept.count() > 3


def test_random_hosts_are_left_alone_and_an_outlier_is_watched(spark):
    """Hosts drawn at random are watched at no more than the stated level; one that fails twice as often always is."""
    import random

    watched = hosts = 0
    for seed in range(12):
        r = random.Random(seed)
        bits = [sum((r.random() < share) << i for i, share in enumerate((0.15, 0.05, 0.1, 0.2, 0.02))) for _ in range(6000)]
        rows = [(f"h{r.randrange(40)}", b) for b in bits]
        found = q.host_verdicts(spark.createDataFrame(rows, "host string, failed long")).collect()
        assert not any(x.rejected for x in found)
        watched, hosts = watched + sum(x.watched > 0 for x in found), hosts + len(found)
    assert hosts == 480 and watched <= max(3, q.LEVEL * hosts)
    rows += [("odd", sum((r.random() < share) << i for i, share in enumerate((0.15, 0.05, 0.5, 0.2, 0.02)))) for _ in range(300)] + [("junk", int(r.random() < 0.9)) for _ in range(200)]
    found = {x.host: x for x in q.host_verdicts(spark.createDataFrame(rows, "host string, failed long")).collect()}
    assert found["odd"].watched & 4 and not found["odd"].rejected and found["junk"].rejected
    assert {h: (x.watched, x.rejected) for h, x in found.items()} == plain_verdicts(rows)


def test_filter_keeps_what_the_query_keeps(edge_docs):
    kept = sorted(str(r.doc_id) for r in q.quality(edge_docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in q.quality_filter(edge_docs).collect()) == kept
