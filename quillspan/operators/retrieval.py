"""Text retrieval: terms, containment, TF-IDF, lexical overlap, and dense nearest neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import Rounds

#: Common words without retrieval value.
STOP_WORDS = tuple("a an and are as at be by for from has have how in is it of on or that the this to was were what when where which who why will with".split())
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Characters by which quotes of one or two words are looked up.
GRAM = 4
#: Characters of passages whose terms a task counts.
CHARS = 1 << 22
#: Queries that a task holds, vectors that it reads (their product, a task's pairs, sets how long it takes), and vectors that it multiplies at once.
QUERY_BLOCK, VECTOR_BLOCK, VECTORS_AT_ONCE = 2048, 8192, 512


def question_terms(question: str, stop: tuple[str, ...] = STOP_WORDS) -> list[str]:
    """Words of three letters and more, in order, without stop words and repetitions."""
    return [w for w in dict.fromkeys(re.findall(r"[a-z]{3,}", question.lower())) if w not in stop]


def contained(texts: DataFrame, quotes: DataFrame, text: str = "text", quote: str = "quote", most: int = 4) -> DataFrame:
    """Every pair of a text and a quote (not empty) that it contains word for word.

    All words of a quote but its first and last one, which may be parts of words there,
    are whole words of the text.  So runs of the text's words meet the first such run of
    each quote, of ``most`` words or as many as it has, and the pairs are then verified.
    Quotes of one or two words have none; their pieces of ``GRAM`` characters, or of as
    many as they have, meet those of the texts.  Texts are numbered once, in a written
    table, so that all branches know the same numbers.
    """
    rounds = Rounds(texts.sparkSession, "contained")
    quotes = quotes.where(F.length(quote) > 0)
    words = F.split(F.col(quote), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.least(F.lit(most), F.size(words) - 2)))
    keyed = quotes.withColumn("__run", inner).withColumn("__n", F.size("__run"))
    sizes = sorted(r[0] for r in keyed.select("__n").distinct().collect())  # most + 1 values at most
    ids = rounds.keep("texts", texts.withColumn("__row", F.monotonically_increasing_id()))

    def hashed(w: str, n: int) -> Column:
        """Hashes of all runs of n words of an array column."""
        return F.transform(w, lambda x, i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))

    long = [n for n in sizes if n]
    met = None
    if long:
        words_of = ids.select("__row", F.split(F.coalesce(F.col(text), F.lit("")), r"\s+").alias("__w"))
        hashes = F.array_distinct(F.flatten(F.array(*(hashed("__w", n) for n in long))))
        asked = keyed.where("__n > 0").withColumn("__key", F.coalesce(*(F.when(F.col("__n") == n, F.xxhash64(*(F.get("__run", F.lit(k)) for k in range(n)))) for n in long)))
        hits = words_of.select("__row", F.explode_outer(hashes).alias("__key")).join(asked.drop("__run", "__n"), "__key").drop("__key")
        met = ids.join(hits, "__row").where(F.col(text).contains(F.col(quote))).drop("__row")
    if 0 in sizes:
        few = keyed.where("__n = 0").drop("__run", "__n").withColumn("__size", F.least(F.lit(GRAM), F.length(quote)))
        lengths = sorted(r[0] for r in few.select("__size").distinct().collect())  # GRAM values at most

        # all pieces of n neighbouring characters, one by one from every place; shorter ones at the end begin no quote of n or more
        pieces = F.array_distinct(F.concat(*(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths)))
        hits = ids.where(F.length(text) > 0).select("__row", F.explode(pieces).alias("__key")).join(few.withColumn("__key", F.substring(F.col(quote), F.lit(1), F.col("__size"))).drop("__size"), "__key").drop("__key")
        short = ids.join(hits, "__row").where(F.col(text).contains(F.col(quote))).drop("__row")
        met = short if met is None else met.unionByName(short)
    return met if met is not None else texts.join(quotes, F.lit(False))


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop))


def grams(text: Column) -> Column:
    """Words and pairs of neighbouring words, after stop words are gone."""

    def both(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))

    # as a lambda's variable the words are found once, not once for each pair
    return F.get(F.transform(F.array(tokens(text)), both), F.lit(0))


def tf_idf(passages: DataFrame, queries: DataFrame, group: str, passage: str, terms: str = "grams", query: str | None = None) -> DataFrame:
    """Cosine score of each passage of a group against the group's queries.

    The corpus is the group itself: tf is 1 + ln(count), idf is ln((1 + n) / (1 + df)) + 1,
    rows have length 1. ``passages``: group, passage, content; ``queries``: group, question
    and, if a group has several, a column ``query`` that tells them apart.  Passages
    without a common term have no row.

    A group's index is made in one shuffle, by group and term, of so many parts that each
    holds CHARS characters of passages on average; terms of these are counted, numbered and
    weighed where they lie.  Only sums for each passage go on from there.
    """
    terms_of = grams if terms == "grams" else tokens
    own = [group] if query is None else [group, query]
    chars = passages.agg(F.sum(F.length("content"))).first()[0] or 0
    parts = max(passages.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS))
    # a group's size travels with its passages, as the index would have to be dealt by group to meet it later
    sized = passages.select(group, passage, "content").join(passages.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), group)
    rows = sized.select(group, passage, "__n", F.explode(terms_of(F.col("content"))).alias("term"))
    rows = rows.where(F.col("term").isNotNull()).repartition(parts, group, "term")  # the filter is the join's; with it in both branches they share the shuffle
    counts = rows.groupBy(group, passage, "term").agg(F.count(F.lit(1)).alias("c"), F.first("__n").alias("n"))
    of_term = Window.partitionBy(group, "term").orderBy(passage)
    df = F.count(F.lit(1)).over(of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    index = counts.select(group, passage, "term", "c", "n", df.alias("df"), (F.row_number().over(of_term) == 1).alias("__first"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    index = index.select(group, passage, "term", "__first", idf.alias("idf"), ((1 + F.log("c")) * idf).alias("__w"))
    length = index.groupBy(group, passage).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__length"))
    asked = queries.select(*own, F.explode(terms_of(F.col("question"))).alias("term")).repartition(parts, group, "term")
    asked = asked.groupBy(*own, "term").agg(F.count(F.lit(1)).alias("__c"))
    both = index.join(asked.hint("merge"), [group, "term"]).withColumn("__q", (1 + F.log("__c")) * F.col("idf"))
    # a query's own length has each of its terms that the group knows once
    once = F.sum(F.when(F.col("__first"), F.col("__q") * F.col("__q")).otherwise(0.0))
    common = both.groupBy(*own, passage).agg(F.sum(F.col("__w") * F.col("__q")).alias("__wq"), once.alias("__qq"))
    common = common.withColumn("__q_length", F.sqrt(F.sum("__qq").over(Window.partitionBy(*own))))
    return common.join(length, [group, passage]).select(*own, passage, (F.col("__wq") / F.col("__length") / F.col("__q_length")).alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct items; 0 for two empty arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int | None = None, limit: tuple[str, str] | None = None) -> DataFrame:
    """query_id, key and score (the dot product, in double precision) of every vector and query, or of each query's ``most`` best ones of every block of vectors; ties by key.

    vectors: key (long), vector; queries: query_id (long), query.  ``limit`` names a number
    of the vectors that may not be above one of the queries.  Null vectors have no score.

    Queries and vectors are dealt to blocks, and every block of queries meets every block
    of vectors in a task of its own: it holds the queries as a matrix, and the vectors
    stream past.  The plan is one shuffle and one pass whatever the number of queries; pairs
    grow with the product of the tables, and so does the number of tasks, not their length.
    """
    bounds = limit or ("__none", "__none")
    low = F.col(bounds[0]).cast("double") if limit else F.lit(0.0)
    high = F.col(bounds[1]).cast("double") if limit else F.lit(0.0)
    asked = queries.where("query IS NOT NULL").select(F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<double>").alias("v"), high.alias("bound"))
    own = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), low.alias("bound"))
    columns, rows = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_BLOCK))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", part(columns)).withColumn("r", numbers(rows)).withColumn("is_vector", F.lit(False))
    right = own.withColumn("r", part(rows)).withColumn("q", numbers(columns)).withColumn("is_vector", F.lit(True))
    met = left.unionByName(right).select("q", "r", "is_vector", "id", "v", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, matrix, best = None, [], None, None

        def chosen(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of rows of one matrix (queries down, keys across): the best ``most`` of each query, by score and key."""
            order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :most]
            return ids, np.take_along_axis(np.broadcast_to(keys, scores.shape), order, axis=1), np.take_along_axis(scores, order, axis=1)

        def written(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            there = scores > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], scores.shape)[there]), pa.array(np.broadcast_to(keys, scores.shape)[there]), pa.array(scores[there])], names=["query_id", key, "score"])

        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, len(place)] if len(place) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.slice(int(a), int(b - a))
                if (place[a, 0], place[a, 1]) != block:
                    if best is not None:
                        yield written(*best)
                    block, held, matrix, best = (place[a, 0], place[a, 1]), [], None, None
                ids, bound = some.column(3).to_numpy(), some.column(5).to_numpy()
                v = some.column(4).flatten().to_numpy().reshape(len(ids), -1)
                if not place[a, 2]:
                    held.append((ids, bound, v))
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix = [np.concatenate(x) for x in zip(*held, strict=True)]
                for at in range(0, len(ids), VECTORS_AT_ONCE):
                    few = slice(at, at + VECTORS_AT_ONCE)
                    scores = matrix[2] @ v[few].T
                    if limit:
                        scores[bound[few][None, :] > matrix[1][:, None]] = -np.inf
                    if most is None:
                        yield written(matrix[0], ids[few][None, :], scores)
                    elif best is None:
                        best = chosen(matrix[0], ids[few][None, :], scores)
                    else:
                        keys = np.concatenate([best[1], np.broadcast_to(ids[few], scores.shape)], axis=1)
                        best = chosen(matrix[0], keys, np.concatenate([best[2], scores], axis=1))
        if best is not None:
            yield written(*best)

    dealt = met.repartitionById(columns * rows, F.col("q") * rows + F.col("r")).sortWithinPartitions("q", "r", "is_vector")
    return dealt.mapInArrow(run, f"query_id long, {key} long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, n: int, vector: str = "embedding", key: str = "vec_id", limit: tuple[str, str] | None = None) -> DataFrame:
    """query_id, key, score and rank of the n vectors of largest dot product for each query; ties by key. Every pair of blocks sends n rows for each of its queries."""
    met = scored(vectors, queries, vector, key, n, limit)
    order = [F.desc("score"), F.col(key)]
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)
