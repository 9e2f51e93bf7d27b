"""URL filters: a few host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

A listed entry is a canonical URL: host in lower case and path, without scheme, query
and fragment.  A URL is listed if its host or a parent domain of it, followed by its
path or, for entries that end in ``/``, by a prefix of the path, is an entry.  The
filter is a table of blocks of 512 bits, as many as the list needs for BITS_PER_ENTRY;
lookups meet it by block, in a broadcast join up to BROADCAST_BYTES and a shuffled one
beyond.  What passes it is joined with the list itself, which removes false positives.  Equal URLs are looked up once, with no more
labels and path steps than some entry has.

Edge cases: a null URL or one without ``://`` has an empty host and path and is
allowed; null, empty and repeated entries of the list are ignored; repeated pages
give repeated results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize

#: Fixed values: (host, path, verdict); the longest fitting rule wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BITS_PER_ENTRY = 16
HASHES = 7
#: A filter of at most so many bytes is broadcast, at BLOCK_BYTES a block in memory.
BROADCAST_BYTES, BLOCK_BYTES = 8 << 20, 128


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES, verdict: bool = False) -> Column:
    """The longest fitting rule as host and path (or its verdict); null if none fits. The rules are a short policy list."""
    found = []
    for rule_host, rule_path, judged in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0])), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found.append(F.when(fits, F.lit(judged if verdict else rule_host + rule_path)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def lookups(host: Column, path: Column, most_labels: int, most_steps: int) -> Column:
    """The list entries that could cover a URL: its host and parent domains of at most ``most_labels`` labels, with the path and those of its prefixes that have at most ``most_steps`` steps."""
    labels = F.split(host, r"\.")
    last = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.least(last, F.lit(most_labels))), lambda n: F.array_join(F.slice(labels, last - n + 1, n), "."))
    full = F.when(path == "", F.lit("/")).otherwise(path)
    steps = F.split(full, "/")
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(steps) - 1, F.lit(most_steps)))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(F.array_append(paths, full), lambda p: F.concat(h, p)))))


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """Word and mask of each of the bits that a key sets in its block."""
    spread = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(spread, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(HASHES)]
    return [(F.shiftrightunsigned(b, 6), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))) for b in bits]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def blocks_for(entries: int) -> int:
    """How many blocks a list needs."""
    return max(1, -(-entries * BITS_PER_ENTRY // 512))


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """The filter of the entries in column ``entry``: block, and its bits as an array of 8 longs."""
    bits = F.array(*(F.struct(w.alias("word"), m.alias("mask")) for w, m in _bits(F.col("entry"))))
    set_bits = entries.select(_block(F.col("entry"), blocks).alias("block"), F.explode(bits).alias("b"))
    words = set_bits.groupBy("block").agg(*(F.bit_or(F.when(F.col("b.word") == w, F.col("b.mask")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(8)))
    return words.select("block", F.array(*(f"w{w}" for w in range(8))).alias("words"))


def listed_urls(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """url_key (host and path) and n (its rows) for every distinct one of ``urls`` (columns host, path and url_key) that an entry (column ``entry``) covers."""
    entries = materialize(entries.select(F.col("entry").cast("string").alias("entry")).where("entry IS NOT NULL AND entry != ''").distinct(), "entries")
    name = F.substring_index("entry", "/", 1)
    # an entry for a prefix has as many steps as slashes; a longer prefix of a URL can't be one
    count, labels, steps = entries.agg(F.count(F.lit(1)), F.max(F.size(F.split(name, r"\."))), F.max(F.size(F.split("entry", "/")) - 1)).first()
    blocks = blocks_for(count)
    distinct = urls.where("url_key IS NOT NULL").groupBy("url_key").agg(F.first("host").alias("host"), F.max("path").alias("path"), F.count(F.lit(1)).alias("n"))
    asked = distinct.select("url_key", "n", F.explode_outer(lookups(F.col("host"), F.col("path"), labels or 1, steps or 1)).alias("entry"))
    hit = F.lit(True)
    for word, mask in _bits(F.col("entry")):
        hit = hit & (F.get(F.col("words"), word).bitwiseAND(mask) != 0)
    table = bloom_filter(entries, blocks)
    table = F.broadcast(table) if blocks * BLOCK_BYTES <= BROADCAST_BYTES else table.hint("merge")
    possible = asked.withColumn("block", _block(F.col("entry"), blocks)).join(table, "block").where(hit)
    return possible.select("url_key", "n", "entry").join(entries, "entry", "left_semi").select("url_key", "n").distinct()


def judge(pages: DataFrame, entries: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), listed, and verdict: the rule's, else block if the URL is listed."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # rows without a host ask for nothing; the others meet their URL's answer, which many of them may share
    urls = urls.withColumn("url_key", F.when(F.col("host") != "", F.concat("host", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")))))
    listed = materialize(listed_urls(urls, entries), "listed").withColumn("listed", F.lit(True))
    judged = attach(urls, listed, "url_key", "n").withColumn("listed", F.coalesce("listed", F.lit(False)))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "listed", F.coalesce(rule_of(F.col("host"), F.col("path"), rules, True), own).alias("verdict"))
