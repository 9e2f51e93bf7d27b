"""Scoring by masked pseudo-likelihood.

A word is predicted from the two words on either side of it: each neighbour, by its
place, adds a vector of its own; a tanh layer over their sum feeds a softmax over
classes of words and one over the words of a class.  A text's score is the sum over
all of its words of the logarithm of the word's probability given both sides.

The vocabulary is made of the corpus's most frequent words, counted over all texts,
and of buckets for the rest.  A word outside it has the probability of its bucket times
its share in the bucket's occurrences, by exact counts of all words, which stay a table
that grows with the corpus and is joined to the texts' words; the shares of the most
frequent of these words, NEAR of them at most, are sent to the tasks instead.  Texts are
split twice: to count their words, and to write them as numbers of two bytes, which the
rounds and the scores read.

The network is trained in numpy in rounds over the whole corpus: each task starts from
the weights of the last round, masks its share of the places of every one of its texts,
takes gradient steps for them, and the tasks' weights are averaged, by the number of
masked places, in a tree of streaming sums.  Over all rounds, every place of every text
is masked exactly once.  Steps follow the order of texts in a task, so another split of
the input into tasks gives slightly other weights, as with any averaged descent.

Edge cases: a null text, or one without words, has no words and score 0; its mean is
null; repeated rows are learned from and scored one by one; an empty table gives an
empty result, and the network stays as it was initialised; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces_of

CLASSES = 64
PER_CLASS = 64
WORDS = CLASSES * PER_CLASS
#: The last quarter of the vocabulary are buckets for words that are not frequent enough.
FREQUENT = WORDS * 3 // 4
EDGE = WORDS  # stands before a text's first word and after its last one
PLACES = (-2, -1, 1, 2)
HIDDEN = 24
ROUNDS = 2
#: Of each text's places, one in so many is masked in a round: the rounds together mask all.
MASKED = ROUNDS
BATCH = 4096
#: Words are scored by so many, whose values stay in the cache.
BLOCK = 1 << 12
RATE = 0.1
#: The tasks' weights are summed by a tree of tasks with so many branches; so many sums at most meet at the driver.
BRANCHES, SUMS = 64, 8
#: Words outside the vocabulary whose shares are sent to all tasks: at most so many, the most frequent ones.
NEAR = 1 << 17
#: Longer runs of one neighbour in a batch are summed by themselves.
LONG_RUN = 12
#: A task hands on its word counts whenever it holds so many.
HELD = 200_000


@dataclass
class Network:
    """places: a table of vectors for each neighbouring place; inner: per class, the words' vectors."""

    places: np.ndarray
    bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape: (draw.normal(size=shape) * 0.1).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        return cls(normal(len(PLACES), WORDS + 1, HIDDEN), zeros(HIDDEN), normal(HIDDEN, CLASSES), zeros(CLASSES), normal(CLASSES, PER_CLASS, HIDDEN), zeros(CLASSES, PER_CLASS))

    def arrays(self) -> list[np.ndarray]:
        return [self.places, self.bias, self.outer, self.outer_bias, self.inner, self.inner_bias]

    def pack(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for a in cls.fresh().arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return cls(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """The layer's values for the neighbours (n, places)."""
        total = self.places[0].take(around[:, 0], axis=0)
        for k in range(1, len(PLACES)):
            total += self.places[k].take(around[:, k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def within(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Each row's logits for the words of its own word's class; ``words`` are sorted, so a class is a product, and what follows is done for all classes at once."""
        inner = self.inner_bias.take(words // PER_CLASS, axis=0)
        for a, b, c in _class_runs(words):
            inner[a:b] += h[a:b] @ self.inner[c].T
        return inner

    def tame(self) -> bool:
        """Whether no logit can be so large that its exponential overflows: the hidden layer's values lie between -1 and 1."""
        outer = np.abs(self.outer).sum(axis=0) + np.abs(self.outer_bias)
        inner = np.abs(self.inner).sum(axis=2) + np.abs(self.inner_bias)
        return bool(max(outer.max(), inner.max()) < 60)

    def log_probability(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word, given its neighbours."""
        out, tame = np.empty(len(words), np.float64), self.tame()
        order = np.argsort(words.astype(np.uint16), kind="stable")  # the words of one class stand together
        for at in range(0, len(order), BLOCK):
            some = order[at : at + BLOCK]
            target, h = words[some], self.hidden(around[some])
            rows = np.arange(len(some))
            outer = h @ self.outer
            outer += self.outer_bias
            value = outer[rows, target // PER_CLASS]
            value -= _log_sum(outer, tame)
            inner = self.within(h, target)
            value += inner[rows, target % PER_CLASS]
            value -= _log_sum(inner, tame)
            out[some] = value
        return out

    def step(self, around: np.ndarray, words: np.ndarray, squares: list[np.ndarray]) -> None:
        """One step of Adagrad for a batch: ``squares`` are the sums of squared gradients, array by array."""
        (touched, g), *dense = self.sparse_gradients(around, words)  # only the vectors of neighbours that the batch has
        vectors, sums = self.places.reshape(-1, HIDDEN), squares[0].reshape(-1, HIDDEN)
        s = sums.take(touched, axis=0)
        s += g * g
        sums[touched] = s
        np.sqrt(s, out=s)
        np.divide(g, s, out=g)
        g *= RATE
        vectors[touched] = vectors.take(touched, axis=0) - g
        for a, g, s in zip(self.arrays()[1:], dense, squares[1:], strict=True):
            s += g * g
            a -= RATE * g / np.sqrt(s)

    def gradients(self, around: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability."""
        (touched, g), *dense = self.sparse_gradients(around, words)
        d_places = np.zeros_like(self.places)
        d_places.reshape(-1, HIDDEN)[touched] = g
        return [d_places, *dense]

    def sparse_gradients(self, around: np.ndarray, words: np.ndarray) -> list:
        """As gradients(), with (numbers, rows) of the batch's neighbours in place of the first array; numbers go through the places' tables, one after the other."""
        order, tame = np.argsort(words.astype(np.uint16), kind="stable"), self.tame()
        around, words = around[order], words[order]
        n, h = len(words), self.hidden(around)
        ones = np.ones(n, np.float32)
        outer = h @ self.outer
        outer += self.outer_bias
        _softmax(outer, tame)
        outer[np.arange(n), words // PER_CLASS] -= 1
        back = outer @ self.outer.T
        d_inner, d_inner_bias = np.zeros_like(self.inner), np.zeros_like(self.inner_bias)
        inner = self.within(h, words)
        _softmax(inner, tame)
        inner[np.arange(n), words % PER_CLASS] -= 1
        for a, b, c in _class_runs(words):
            own = inner[a:b]
            back[a:b] += own @ self.inner[c]
            np.matmul(own.T, h[a:b], out=d_inner[c])
            np.matmul(ones[: b - a], own, out=d_inner_bias[c])
        back *= 1 - h * h
        own = (around + _TABLES).T.astype(np.uint16).ravel()  # place by place
        by = np.argsort(own, kind="stable")
        own = own.take(by)
        by %= n
        sums = run_sums(back.take(by, axis=0), own)
        sums /= n
        touched = own[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])].astype(np.intp)
        return [(touched, sums), *(g / n for g in (ones @ back, h.T @ outer, ones @ outer, d_inner, d_inner_bias))]


def run_sums(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The sums of the rows of each run of equal keys: the n-th rows of all runs that have one are added at once, long runs one by one."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    sums = rows.take(first, axis=0)
    short = np.flatnonzero((size > 1) & (size <= LONG_RUN))
    for n in range(1, LONG_RUN):
        short = short[size[short] > n]
        if not len(short):
            break
        sums[short] += rows.take(first[short] + n, axis=0)
    for run in np.flatnonzero(size > LONG_RUN).tolist():
        a = first[run]
        sums[run] = _COUNT[: size[run]] @ rows[a : a + size[run]]
    return sums


_COUNT = np.ones(1 << 16, np.float32)
#: Where each place's table begins among all vectors; these numbers have two bytes.
_TABLES = np.arange(len(PLACES)) * (WORDS + 1)
_ONES = np.ones(PER_CLASS, np.float32)  # a product with it sums rows; there are as many classes as words in one


def _log_sum(x: np.ndarray, tame: bool) -> np.ndarray:
    """Logarithm of each row's summed exponentials; ``x`` is overwritten."""
    if tame:
        return np.log(np.exp(x, out=x) @ _ONES)
    top = x.max(axis=1)
    x -= top[:, None]
    return top + np.log(np.exp(x, out=x) @ _ONES)


def _softmax(x: np.ndarray, tame: bool) -> None:
    """Each row becomes its probabilities, in place."""
    if not tame:
        x -= x.max(axis=1)[:, None]
    np.exp(x, out=x)
    x *= (1 / (x @ _ONES))[:, None]


def _class_runs(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and class of the runs of words of one class, in sorted words."""
    classes = words // PER_CLASS
    starts = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if len(words) else []
    for a, b in zip(starts, [*starts[1:], len(words)], strict=True):
        yield int(a), int(b), int(classes[a])


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Vocabulary(dict):
    """Numbers of the frequent words; others fall into buckets by a checksum."""

    def __missing__(self, word: str) -> int:
        return bucket_of(word)


def in_line(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of all texts with two edges before, between and after the texts; and where each word stands."""
    sizes = np.diff(np.r_[0, ends])
    at = np.arange(len(words)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    line = np.full(len(words) + 2 * (len(sizes) + 1), EDGE, np.uint16)
    line[at] = words
    return line, at


def numbered(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: their numbers, their neighbours' numbers (n, places); and where each text's words end."""
    own = [[vocabulary[w] for w in words_of(t)] for t in texts]
    ends = np.cumsum([len(x) for x in own], dtype=np.int64)
    words = np.array([x for t in own for x in t], np.uint16)
    line, at = in_line(words, ends)
    return words, np.stack([line[at + k] for k in PLACES], axis=1), ends


def bucket_of(word: str) -> int:
    return FREQUENT + crc32(word.encode()) % (WORDS - FREQUENT)


def count_words(docs: DataFrame) -> DataFrame:
    """word and n for every word of the corpus; each task counts before anything is shuffled."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in pieces_of(batches, 0, 4 << 20):
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """The vocabulary: the FREQUENT most frequent words of all texts, ties in order of the words."""
    top = (count_words(docs) if counts is None else counts).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return Vocabulary({r["word"]: i for i, r in enumerate(top)})


def shares(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word, n and share for every word outside the vocabulary: the logarithm of its part in its bucket's occurrences."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(w,) for w, i in vocabulary.items() if i < FREQUENT], "word string")
    rest = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.crc32(F.col("word").cast("binary")) % (WORDS - FREQUENT))
    totals = rest.groupBy("bucket").agg(F.sum("n").alias("all"))
    return rest.join(F.broadcast(totals), "bucket").select("word", "n", F.log(F.col("n") / F.col("all")).alias("share"))


def masked(words: np.ndarray, ends: np.ndarray, turn: int, ids: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words that a round masks, and their neighbours: every MASKED-th of each text; the first depends on the round and the text's id, so copies differ."""
    starts = np.r_[0, ends[:-1]]
    shift = np.array([(i or 0) % MASKED for i in ids or [0] * len(ends)], np.int64) - starts
    own = np.flatnonzero((np.arange(len(words)) + np.repeat(shift, ends - starts)) % MASKED == turn)
    line, at = in_line(words, ends)
    at = at[own]
    return words[own], np.stack([line[at + k] for k in PLACES], axis=1)


def learn(net: Network, batches: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], turn: int) -> tuple[Network, int]:
    """The network after one task's steps (Adagrad), and how many masked places it saw. Batches: ids, words and ends of texts."""
    squares = [np.full_like(a, 1e-6) for a in net.arrays()]
    seen, waiting, held = 0, [], 0

    for ids, own, ends in batches:
        words, around = masked(own, ends, turn, ids)
        waiting.append((around, words))
        held += len(words)
        if held >= 4 * BATCH:
            around, words = (np.concatenate(x) for x in zip(*waiting, strict=True))
            whole = held // BATCH * BATCH
            for at in range(0, whole, BATCH):
                net.step(around[at : at + BATCH], words[at : at + BATCH], squares)
            waiting, seen, held = [(around[whole:], words[whole:])], seen + whole, held - whole
    if held:
        around, words = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for at in range(0, held, BATCH):
            net.step(around[at : at + BATCH], words[at : at + BATCH], squares)
    return net, seen + held


_SUM = pa.schema([("n", pa.int64()), ("weights", pa.binary())])


def words_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and ends of the texts in a column of numbers."""
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), "<u2"), np.cumsum([len(t) // 2 for t in texts], dtype=np.int64)


def one_round(encoded: DataFrame, net: Network, turn: int) -> Network:
    """All tasks' steps from the same weights, averaged by the places that they saw. ``encoded``: doc_id and numbers of the texts."""
    spark = encoded.sparkSession
    start = spark.sparkContext.broadcast(net.pack())  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = start.value
        own, n = learn(Network.unpack(weights), ((b.column(0).to_pylist(), *words_in(b.column(1))) for b in pieces_of(batches, 1, 2 << 20)), turn)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(own.pack() - weights).astype(np.float32).tobytes()], pa.binary())], schema=_SUM)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, moved = 0, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float32).astype(np.float64) * k
                n, moved = n + k, part if moved is None else moved + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(moved / n).astype(np.float32).tobytes()], pa.binary())], schema=_SUM)

    rows = encoded.select("doc_id", "numbers")
    sums, tasks = rows.mapInArrow(run, "n long, weights binary"), rows.rdd.getNumPartitions()
    while tasks > SUMS:
        tasks = max(SUMS, -(-tasks // BRANCHES))
        sums = sums.repartition(tasks).mapInArrow(total, "n long, weights binary")
    sums = sums.collect()
    start.unpersist()
    if not sums:
        return net
    n = sum(r["n"] for r in sums)
    return Network.unpack(net.pack() + sum(np.frombuffer(r["weights"], np.float32) * (r["n"] / n) for r in sums))


def train(encoded: DataFrame) -> Network:
    net = Network.fresh()
    for turn in range(ROUNDS):
        net = one_round(encoded, net, turn)
    return net


#: A text as numbers: the sum of the shares that were sent to the task, and its other words with their counts.
_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("shares", pa.float64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])
ENCODED = "row long, doc_id long, numbers binary, shares double, rare array<string>, times array<long>"


def encode(docs: DataFrame, vocabulary: Vocabulary, near: dict[str, float]) -> DataFrame:
    """A row of ENCODED for each text (doc_id, text). ``near``: shares of words outside the vocabulary; they travel to the tasks, FREQUENT and NEAR words at most."""
    known = [*(w for w, i in vocabulary.items() if i < FREQUENT), *near]
    model = docs.sparkSession.sparkContext.broadcast((known, [*(i for i in vocabulary.values() if i < FREQUENT), *map(bucket_of, near)], [0.0] * (len(known) - len(near)) + list(near.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers, shares = model.value
        place = {w: i for i, w in enumerate(words)}
        numbers, shares = np.array([*numbers, 0], np.uint16), np.array([*shares, 0.0])  # the last one stands for a word that isn't known
        other = len(words)
        for batch in pieces_of(batches, 2, 4 << 20):
            parts, rare, times = [], [], []
            sums = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = words_of(text)
                at = np.fromiter(map(place.get, own, itertools.repeat(other)), np.int64, len(own))
                found = numbers[at]
                sums[i] = shares[at].sum()
                unknown = np.flatnonzero(at == other).tolist()
                held: Counter[str] = Counter()
                if unknown:
                    some = [own[k] for k in unknown]
                    found[unknown] = list(map(bucket_of, some))
                    held.update(some)
                parts.append(found.astype("<u2").tobytes())
                rare.append(list(held))
                times.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary()), pa.array(sums), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], schema=_ENCODED)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(run, ENCODED), "encoded")


def sums_of(net: Network, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The summed log-probability of each text."""
    line, at = in_line(words, ends)
    sums = np.r_[0.0, np.cumsum(net.log_probability(np.stack([line[at + k] for k in PLACES], axis=1), words))]
    return sums[ends] - sums[np.r_[0, ends[:-1]]]


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, score (the summed log-probability) and mean_score."""
    counts = materialize(count_words(docs), "words")
    vocabulary = frequent_words(docs, counts)
    rare = materialize(shares(counts, vocabulary), "shares")
    top = rare.orderBy(F.desc("n"), "word").limit(NEAR).collect()
    rest = rare.where((F.col("n") < top[-1]["n"]) | ((F.col("n") == top[-1]["n"]) & (F.col("word") > top[-1]["word"]))) if top else rare
    encoded = encode(docs, vocabulary, {r["word"]: r["share"] for r in top})
    model = docs.sparkSession.sparkContext.broadcast(train(encoded).pack())  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpack(model.value)
        for batch in pieces_of(batches, 2, 2 << 20):
            words, ends = words_in(batch.column(2))
            n = np.diff(np.r_[0, ends])
            total = np.where(n > 0, sums_of(net, words, ends) + batch.column(3).to_numpy(zero_copy_only=False), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total)], names=["row", "doc_id", "n_words", "score"])

    own = encoded.select("row", "doc_id", "numbers", "shares").mapInArrow(run, "row long, doc_id long, n_words long, score double")
    # a text's own row has a key that no word can be, so that these spread in the join
    parts = own.withColumn("word", F.concat(F.lit(" "), F.col("row").cast("string"))).withColumn("k", F.lit(None).cast("long"))
    others = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("double").alias("score"), F.col("w.rare").alias("word"), F.col("w.times").alias("k"))
    # A word outside the vocabulary is rarer than each of the FREQUENT words in it, so no key of this join is hot.
    both = parts.unionByName(others).join(rest.select("word", "share").hint("merge"), "word", "left")
    value = F.coalesce(F.col("score"), F.col("k") * F.col("share"))
    found = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(value).alias("score"))
    return found.select("doc_id", "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"))
