import re

import pytest

from quillspan.llm import url_filter as u

URLS = [None, "", "no scheme", "http://A.Example.com/en/7x?q=/x#f", "https://m.example.com/en/6", "http://example.net/de/81", "http://x.net/de/1", "ftp://org", "http://org/es/", "http://borg/es/1", "x://spam.com", "x://www.SPAM.com/a/b?x", "x://notspam.com/", "x://a.b/dir/page", "x://a.b/dir2", "x://a.b/dir/", "x://com/en/://", "a\nb://com/en/"]
LIST = ["spam.com/", "a.b/dir/page", "q.r/", None, "", "spam.com/"]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    full = path or "/"
    listed = False
    for entry in filter(None, LIST):
        h, p = entry[: entry.index("/")], entry[entry.index("/") :]
        listed |= host != "" and (host == h or host.endswith("." + h)) and (full == p or p.endswith("/") and full.startswith(p))
    return host, path, rule, listed, verdict or ("block" if listed else "allow")


@pytest.mark.parametrize("broadcast, bits", [(8 << 20, 16), (0, 16), (0, 4096)])
def test_verdicts_equal_plain_rules(spark, monkeypatch, broadcast, bits):
    monkeypatch.setattr(u, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(u, "BITS_PER_ENTRY", bits)
    pages = spark.createDataFrame([(i, x, "h", "r") for i, x in enumerate(URLS)] + [(None, URLS[4], "h", "r")], "page_id long, url string, host string, rule string")
    got = u.judge(pages, spark.createDataFrame([(x, 1) for x in LIST], "entry string, host int")).collect()
    want = [(i, *plain(x)) for i, x in enumerate(URLS)] + [(None, *plain(URLS[4]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    entries = spark.createDataFrame([(f"h{i}.com/",) for i in range(3000)], "entry string")
    blocks = -(-3000 * u.BITS_PER_ENTRY // 512)
    table = {r.block: r.words for r in u.bloom_filter(entries, blocks).collect()}
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([(f"h{i}.com/",) for i in range(6000)], "entry string").select("entry", u._block(F.col("entry"), blocks).alias("block"), *[c.alias(f"{k}{i}") for i, pair in enumerate(u._bits(F.col("entry"))) for k, c in zip("wm", pair)])
    hits = {r.entry for r in asked.collect() if r.block in table and all(table[r.block][r[f"w{i}"]] & r[f"m{i}"] for i in range(u.HASHES))}
    assert {f"h{i}.com/" for i in range(3000)} <= hits and len(hits) < 3150


def test_blocks_grow_with_the_list(spark):
    """At the stated bits an entry a list of any length lets few others pass."""
    from pyspark.sql import functions as F

    assert all(u.blocks_for(n) * 512 >= n * u.BITS_PER_ENTRY for n in (1, 33, 2_000_000, 3_000_000_000))
    n = 120_000
    entries = spark.range(n).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("entry"))
    others = spark.range(n, 2 * n).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("entry"))
    blocks = u.blocks_for(n)
    assert blocks > 3000
    hit = F.lit(True)
    for word, mask in u._bits(F.col("entry")):
        hit = hit & (F.get("words", word).bitwiseAND(mask) != 0)
    table = u.bloom_filter(entries, blocks)
    passed = lambda asked: asked.withColumn("block", u._block(F.col("entry"), blocks)).join(table, "block").where(hit).count()
    assert passed(entries) == n and passed(others) < 0.004 * n


def test_hot_and_rare_urls_take_both_joins(spark, monkeypatch):
    from quillspan.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    urls = URLS + ["x://spam.com/hot"] * 40 + ["x://spam.com/rare", "x://a.b/dir/page", "x://spam.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = u.judge(pages, spark.createDataFrame([(x,) for x in LIST], "entry string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain(x))) for i, x in enumerate(urls))


def test_long_paths_ask_for_no_more_steps_than_the_list_has(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a.b.c.d", "/" + "x/" * 5000)], "host string, path string").select(u.lookups(F.col("host"), F.col("path"), 2, 3).alias("e")).first()
    assert len(row.e) == 8 and {"d/", "d/x/", "d/x/x/", "c.d/", "c.d/x/", "c.d/x/x/"} < set(row.e)


def test_the_query_spans_many_blocks(spark):
    from quillspan.llm.queries import op8_url_filter, table, url_list

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    assert url_list(pages).distinct().count() * u.BITS_PER_ENTRY > 4 * 512
    verdicts = op8_url_filter(spark, "/root/testdata/sf0.01")
    assert verdicts.where("listed AND rule IS NULL").count() > 20


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(none, spark.createDataFrame([], "entry string")).count() == 0
