"""License scans by diagonal voting, with DataFrame functions only.

Every run of three words of every text is hashed and joined with the positions of
such runs in license templates; the words of each match are compared.  A match votes
for its diagonal, the offset between text and template.  A template's votes on one
diagonal are an exact copy if they cover all of it; neighbouring diagonals (words
added or left out) are merged, and the merged span counts if it covers enough of the
template.  Each text also sends one marker, so that texts without matches come out
of the same pass.

Edge cases: a null text counts as empty; repeated rows are scanned together and come
out as often as they came in; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
#: Diagonals at most so far apart belong to one span.
NEAR = 4
#: The least share of a template's word runs that a span has to cover.
COVERED = 0.7
#: Phrases that give a label where their words stand consecutively.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Opening words of licenses and license notes; at most 65 words each, so that a template's runs fit 63 bits.
NOTES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
MARKER = "\x00"  # no word


def words_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def templates(spark: SparkSession, phrases: tuple = PHRASES, notes: tuple = NOTES) -> DataFrame:
    """A row per word run: hash, template, label, whether it is a base phrase, position, its words, runs in the template; and the marker's row."""
    rows = []
    for n, (words, label, base) in enumerate([(p.split(), label, True) for p, label in phrases] + [(p.split(), label, False) for p, label in notes]):
        rows += [(n, label, base, at, words[at : at + K], len(words) - K + 1) for at in range(len(words) - K + 1)]
    rows.append((-1, None, False, 0, [MARKER] * K, 1))
    made = spark.createDataFrame(rows, "template int, label string, base boolean, at int, run array<string>, runs int")
    return made.withColumn("hash", F.xxhash64(*(F.col("run")[i] for i in range(K))))


def scan(docs: DataFrame, phrases: tuple = PHRASES, notes: tuple = NOTES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest covered share)."""
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), words_of(F.col("text")).alias("words"))
    # a run carries its own three words and no more, so that a text's rows take space in proportion to its length
    run = F.transform("words", lambda w, i: F.struct((i + 1).alias("p"), F.array(w, F.get("words", i + 1), F.get("words", i + 2)).alias("own")))
    marked = F.concat(F.array(F.struct(F.lit(0).alias("p"), F.array(*[F.lit(MARKER)] * K).alias("own"))), run)
    # counted before the explode: an array that is still asked for after it would be copied with each row. The explode is an
    # outer one (the array is never empty), as Spark puts a filter on an inner one's size below it, which finds all words again
    counted = words.select("doc_id", "h", "n", F.size("words").cast("long").alias("n_words"), marked.alias("marked"))
    runs = counted.select("doc_id", "h", "n", "n_words", F.explode_outer("marked").alias("run_of"))
    runs = runs.select("doc_id", "h", "n", "n_words", F.col("run_of.p").alias("p"), F.col("run_of.own").alias("own"), F.xxhash64(*(F.col("run_of.own")[i] for i in range(K))).alias("hash"))
    found = runs.join(F.broadcast(templates(docs.sparkSession, phrases, notes)), "hash")  # a fixed table of a few hundred rows
    same = ((F.col("template") < 0) == (F.col("p") == 0)) & (F.col("own") == F.col("run"))
    key = ["doc_id", "h", "n", "n_words"]
    votes = (
        found.where(same)
        .select("doc_id", "h", "n", "n_words", "template", "label", "base", "runs", (F.col("p") - 1 - F.col("at")).alias("diagonal"), "at")
        .groupBy(*key, "template", "label", "base", "runs", "diagonal")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("seen"), F.count(F.lit(1)).alias("copies"))
    )
    exact = F.col("base") & (F.bit_count("seen") == F.col("runs"))
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEAR, 0).otherwise(1)
    grouped = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(line))
    spans = grouped.groupBy(*key, "template", "label", "base", "runs", "span").agg(
        F.max("copies").alias("copies"), F.bit_or("seen").alias("seen"), F.sum(F.when(exact, 1).otherwise(0)).alias("places"), F.min(F.when(exact, F.col("diagonal"))).alias("first"), F.max(F.when(exact, F.col("diagonal"))).alias("last")
    )
    share = F.when(F.col("template") < 0, 0.0).when(F.col("base"), F.when(F.col("places") > 0, 1.0).otherwise(0.0)).otherwise(F.bit_count("seen") / F.col("runs"))
    labelled = F.when((F.col("places") > 0) | (~F.col("base") & (F.col("share") >= COVERED)), F.col("label"))
    join = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    judged = (
        spans.withColumn("share", share)
        .groupBy(*key)
        .agg(
            F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"), F.sum("places").cast("long").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
            join(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"), join(labelled).alias("labels"), F.max("share").alias("score"),
        )
    )
    return judged.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
