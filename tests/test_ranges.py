"""Running sums by ranges, permutations, the bootstrap's spread, and global places."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import ranges, stats


@pytest.fixture
def rows(spark):
    r = random.Random(3)
    own = [(i, r.choice("abc"), r.randrange(5) if r.random() < 0.9 else None) for i in r.sample(range(10_000), 800)]
    return own, spark.createDataFrame(own, "k long, g string, w int").repartition(7)


def test_running_sums_and_ranks(rows):
    own, df = rows
    want, total = {}, 0
    for k, _, w in sorted(own):
        want[k] = total
        total += w or 0
    assert {r.k: r.before for r in ranges.running(df, ["k"], F.col("w")).collect()} == want
    ranked = ranges.running(df, ["g", "k"], None, "rank").collect()
    assert [r.rank for r in sorted(ranked, key=lambda r: (r.g, r.k))] == list(range(800))
    assert ranges.running(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("target", [0, 1, 500, 10**6])
def test_rows_until_a_target(rows, target):
    own, df = rows
    kept, total = [], 0
    for k, _, w in sorted(own):
        if total >= target:
            break
        kept.append(k)
        total += w or 0
    assert sorted(r.k for r in ranges.until(df, ["k"], F.col("w"), target).collect()) == kept


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutations_are_bijections(spark, n):
    numbers = spark.range(n).select("id", ranges.permuted(F.col("id"), n, "s").alias("p"), ranges.permuted(F.col("id"), n, "t").alias("q")).orderBy("id").collect()
    assert sorted(r.p for r in numbers) == sorted(r.q for r in numbers) == list(range(n))
    if n >= 64:
        assert [r.p for r in numbers] != [r.q for r in numbers] and sum(r.p == r.id for r in numbers) < n / 8
        assert abs(sum((r.p - (n - 1) / 2) * (r.id - (n - 1) / 2) for r in numbers)) < 0.5 * n**3 / 12


def test_aliases(spark):
    df = spark.createDataFrame([(i * 7, "x") for i in range(50)], "k long, alias_of string")
    one, two = ([(r.k, r.alias) for r in ranges.aliases(df.repartition(p), "k", "seed").orderBy("k").collect()] for p in (1, 6))
    assert one == two and sorted(a for _, a in one) == sorted(f"P{i}" for i in range(1, 51))
    assert ranges.aliases(df.limit(0), "k", "seed").count() == 0


@pytest.mark.parametrize("n", [12, 100, 400])
def test_the_bootstrap_spreads_like_a_bootstrap(spark, n):
    """Resampled means spread by s / sqrt(n), and a sample holds about 0.63 of the families."""
    r = random.Random(n)
    values = [r.gauss(0, 1) for _ in range(n)]
    mean = sum(values) / n
    s = (sum((v - mean) ** 2 for v in values) / n) ** 0.5
    found = stats.cluster_bootstrap(spark.createDataFrame([(f"f{i:04}", v) for i, v in enumerate(values)], "f string, v double"), "f", "v", 800).first()
    width = 2 * 1.96 * s / n**0.5
    assert found.families == n and abs(found.mean - mean) < 1e-9 and 0.85 < (found.high - found.low) / width < 1.15
    picks = spark.range(800 * n).select(F.floor(F.col("id") / n).alias("sample"), stats.drawn(F.floor(F.col("id") / n), F.col("id") % n, F.lit(n)).alias("i"))
    distinct = picks.distinct().count() / (800 * n)
    assert abs(distinct - (1 - (1 - 1 / n) ** n)) < 0.02
