"""Quality rules on documents, and verdicts on their hosts.

Each text is measured once: the base rules, and graded rules (RULES) that alone reject
nothing.  Failures of every rule are counted by host (the ``source`` column); for each
rule a beta prior is fitted to all hosts by moments, with the sampling variance taken
off, and shrinks the hosts' rates.  A host is *watched* for a rule if its rate is
surely, by SURE posterior deviations, above WATCHED times the corpus's; its documents
that fail this rule are rejected.  A host is *rejected*, with all its documents, if its
rate of base failures is surely, by DEVIATIONS, above REJECTED.  Where hosts differ by
no more than sampling explains, the prior is a point and no host has a verdict.
Verdicts return to the documents by a join with the hosts.

A host that is like the corpus is watched for some rule with a chance of at most LEVEL:
a normal tail beyond SURE for each of the rules.

Edge cases: a null text counts as empty (no words: it fails); a null host has no
verdict of its own, so its documents are judged by their text alone; repeated rows
are measured and counted one by one; an empty table gives an empty result; other
columns are ignored (or kept by ``quality_filter``, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import attach, map_rows, materialize, unused

WHITESPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host is watched for a rule if its rate lies above so many times the corpus's by this many posterior deviations.
WATCHED, SURE = 1.1, 3.0
#: Chance that a host which is like the corpus is watched: five tails of 0.00135.
LEVEL = 0.007
#: A host is rejected if its rate of base failures lies above this by so many posterior deviations.
REJECTED, DEVIATIONS = 0.5, 2.0
#: The prior counts for at least so many documents.
WEAKEST = 2.0
#: Rules as SQL conditions on the measures (DuckDB reads them alike); the first counts the base rules.
RULES = (
    ("base", "base_failed"),
    ("symbols", "10 * n_symbols > n_words"),
    ("lines", "n_dup_lines >= 2"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("lengths", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
NAMES = [c.split()[0] for c in MEASURES.split(", ")]


def words_in_repeated_windows(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that occurs twice or more in the list."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    codes, base = ids, len(known)
    for k in range(1, width):
        if int(codes.max()) >= 2**62 // base:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes[:-1] * base + ids[k:]
    _, back, count = np.unique(codes, return_inverse=True, return_counts=True)
    repeated = count[back] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : k + len(repeated)] |= repeated
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows, and whether a base rule fails."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    repeated = words_in_repeated_windows(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    return len(words), len(text) - sum(map(text.count, WHITESPACE)), sum(map(text.count, SYMBOLS)), dup_lines, repeated, failed


_MEASURED = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_())])


def measure_documents(docs: DataFrame) -> DataFrame:
    """A row of measures per document: doc_id, host, and the columns of MEASURES."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("source").cast("string").alias("host"))
    return rows.mapInArrow(map_rows(lambda: lambda doc_id, text, host: (doc_id, host, *measure(text)), _MEASURED), f"doc_id long, host string, {MEASURES}")


def failures() -> Column:
    """The rules that a row of measures fails, as bits: 1 for the first rule, 2 for the second, ..."""
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0)).cast("long")


def host_verdicts(failed: DataFrame) -> DataFrame:
    """Host, its documents, the rules it is watched for (bits) and whether it is rejected. ``failed``: host and, in ``failed``, the bits of each document.

    Counts by host and rule are few rows; the prior of a rule has the corpus's rate p
    and the strength k = 1 / rho - 1, where rho is the share of the hosts' variance that
    binomial sampling doesn't explain; if there is none, k is infinite (null here).
    """
    bit = [F.sum(F.shiftright("failed", i).bitwiseAND(F.lit(1))).alias(f"x{i}") for i in range(len(RULES))]
    hosts = failed.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *bit)
    counts = hosts.select("host", "n", F.posexplode(F.array(*(f"x{i}" for i in range(len(RULES))))).alias("rule", "x"))
    total = counts.groupBy("rule").agg(F.sum("n").alias("n_all"), F.sum("x").alias("x_all"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
    total = total.withColumn("p", F.col("x_all") / F.col("n_all"))
    spread = counts.join(F.broadcast(total), "rule").groupBy("rule").agg(F.sum(F.col("n") * (F.col("x") / F.col("n") - F.col("p")) * (F.col("x") / F.col("n") - F.col("p"))).alias("spread"))
    sampled = F.col("p") * (1 - F.col("p"))
    rho = (F.col("spread") - sampled * (F.col("hosts") - 1)) / (sampled * (F.col("n_all") - F.col("nn") / F.col("n_all") - (F.col("hosts") - 1)))
    prior = total.join(F.broadcast(spread), "rule").withColumn("rho", F.when((sampled > 0) & (F.col("hosts") > 1), rho))
    prior = prior.select("rule", "p", F.when(F.col("rho") > 0, F.greatest(F.lit(WEAKEST), 1 / F.col("rho") - 1)).alias("k"))
    rate = (F.col("x") + F.col("p") * F.col("k")) / (F.col("n") + F.col("k"))
    shrunk = counts.join(F.broadcast(prior), "rule").withColumn("rate", rate)  # a row per rule
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("k") + 1))
    low = F.col("rate") - DEVIATIONS * deviation
    watched = F.when(F.col("rate") - SURE * deviation > WATCHED * F.col("p"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rule"))).otherwise(F.lit(0).cast("long"))
    return shrunk.groupBy("host").agg(F.max("n").alias("n"), F.sum(watched).alias("watched"), F.max((F.col("rule") == 0) & (low > REJECTED)).alias("rejected"))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, failed_rules (comma-joined), host_rejected and kept."""
    measured = materialize(measure_documents(docs).withColumn("failed", failures()), "quality")
    verdicts = materialize(host_verdicts(measured.select("host", "failed")), "hosts").withColumnRenamed("n", "rows_of_host")
    judged = attach(measured, verdicts, "host", "rows_of_host").withColumn("host_rejected", F.coalesce("rejected", F.lit(False)))
    names = F.concat_ws(",", *(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES))
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & (F.coalesce(F.col("failed").bitwiseAND(F.col("watched")), F.lit(0)) == 0)
    return judged.select("doc_id", *NAMES, names.alias("failed_rules"), "host_rejected", kept.alias("kept"))


def _failures(text: pa.Array) -> pa.Array:
    """``failures`` of a column of texts, in numpy."""
    out = []
    for at in range(0, len(text), 256):  # a slice at a time: a batch of long texts is never in Python all at once
        for n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed in map(measure, text.slice(at, 256).to_pylist()):
            own = (base_failed, 10 * n_symbols > n_words, n_dup_lines >= 2, 100 * n_repeat_words > 20 * n_words, not 3 * n_words <= word_chars <= 12 * n_words)
            out.append(sum(1 << i for i, fails in enumerate(own) if fails))
    return pa.array(out, pa.int64())


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) that no base rule, no watched rule of their host and no host verdict rejects. Each text is measured once, and its bits are kept with its row."""
    host, failed = unused(docs, "host_of_doc"), unused(docs, "failed_bits")
    rows = docs.withColumns({host: F.col("source").cast("string"), failed: F.arrow_udf(_failures, LongType())(F.col("text"))})
    measured = materialize(rows, "measured")
    verdicts = materialize(host_verdicts(measured.select(F.col(host).alias("host"), F.col(failed).alias("failed"))), "hosts")
    watched, rejected = unused(measured, "host_watched"), unused(measured, "host_rejected")
    judged = attach(measured, verdicts.select(F.col("host").alias(host), F.col("n").alias("rows_of_host"), F.col("watched").alias(watched), F.col("rejected").alias(rejected)), host, "rows_of_host")
    fails = F.col(failed).bitwiseAND(F.lit(1)) + F.coalesce(F.col(failed).bitwiseAND(F.col(watched)), F.lit(0))
    return judged.where((fails == 0) & ~F.coalesce(F.col(rejected), F.lit(False))).select(docs.columns)
