"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word (a stretch of letters and digits, or of other signs, as it is written) has
one of ``BUCKETS`` numbers by its hash, and every number a sparse random index vector.
Over the whole corpus a word's vector is the sum of the index vectors of the words near
it (``word_vectors``): each task sums its own texts, the sums of tasks are added by
blocks of numbers, so nothing grows with the corpus but the counts.  A document is the
weighted mean and spread of its words' vectors, rarer words counting for more.  A
network of two layers, trained with numpy on at most ``MOST_LABELLED`` labelled
documents of each label (those with the least hashes), gives a logit; a temperature,
fitted on a part of them that the weights never saw, makes it a probability.

Edge cases: a text that is null or has no word is pooled as zeros and scored like all
others; without labels of both kinds every score is the share of label 1 (0.5 without
any); a document with different labels counts by their mean, at 0.5 as 1; null labels,
null ids and labels without a document teach nothing; repeated rows give repeated
results and are learned once; a null doc_id counts as the empty text in the fold; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces_of

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Entries of an index vector that are 1 or -1.
NONZERO = 4
WINDOW = 2
BLOCKS = 64
#: A word with this share of all words counts half as much as a rare one.
COMMON = 1e-3
HIDDEN = 24
MOST_LABELLED = 6000
#: One of so many labelled documents is kept for the temperature.
CALIBRATION = 5
EPOCHS, BATCH, RATE, DECAY = 60, 64, 0.004, 1e-4
THRESHOLD = 0.3
#: Bytes that are read at once.
AT_ONCE = 1 << 20

_SPACE, _WORD, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[:33] = _SPACE
_KIND[128:] = _WORD
for _first, _last in (b"09", b"AZ", b"az"):
    _KIND[_first : _last + 1] = _WORD
#: A byte's part in the hash of its word, by its place there; places from the 32nd on are alike.
_PLACES = 32
_PARTS = np.random.default_rng(17).integers(0, 1 << 63, (_PLACES * 256), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    r = np.random.default_rng(23)
    places = np.argsort(r.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, r.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words of the texts, one after another, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    begin = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    size = np.diff(np.concatenate([begin, [len(data)]]))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    hashed = np.add.reduceat(_PARTS[np.minimum(place, _PLACES - 1) * 256 + data], begin) * _MIX
    is_word = kind[begin] != _SPACE
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(is_word)])[np.searchsorted(begin, ends)]]))
    return (hashed[is_word] >> np.uint64(64 - 14)).astype(np.int64), count


def slices(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts in UTF-8, some of them (one at least, AT_ONCE bytes or little more) at a time."""
    some, size = [], 0
    for text in texts:
        some.append((text or "").encode())
        size += len(some[-1])
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def add_contexts(into: np.ndarray, words: np.ndarray, count: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each word's row of ``into`` the index vectors of the words up to WINDOW away in its text."""
    text = np.repeat(np.arange(len(count)), count)
    for away in range(1, WINDOW + 1):
        near = text[away:] == text[:-away]
        left, right = words[:-away][near], words[away:][near]
        for k in range(NONZERO):
            for own, other in ((left, right), (right, left)):
                into += np.bincount(own * DIMENSIONS + places[other, k], signs[other, k], into.size).reshape(into.shape)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every bucket's vector (of length 1, or 0 if the corpus doesn't have it) and weight, from all texts."""
    block = BUCKETS // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, counts = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            if waiting:
                words, count = map(np.concatenate, zip(*waiting, strict=True))
                add_contexts(sums, words, count, places, signs)
                np.add(counts, np.bincount(words, minlength=BUCKETS), out=counts)
                waiting.clear()

        for batch in batches:
            for piece in pieces_of([batch], 0, 4 << 20):
                for some in slices(piece.column(0).to_pylist()):
                    waiting.append(words_of(some))
                    if sum(len(w) for w, _ in waiting) >= 1 << 18:
                        add()
        add()
        if counts.any():
            both = [np.ascontiguousarray(x).astype("<i8").reshape(BLOCKS, -1) for x in (sums, counts)]
            packed = [np.concatenate([a, b]).tobytes() for a, b in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(sums, "<i8")
                total[n] = total[n] + own if n in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    form = "block int, sums binary"  # two megabytes in all for each task before, whatever it read
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, form).repartition(8, "block").mapInArrow(add_up, form).collect()
    sums, counts = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    for n, packed in found:
        own = np.frombuffer(packed, "<i8")
        sums[n * block : (n + 1) * block] = own[: block * DIMENSIONS].reshape(block, -1)
        counts[n * block : (n + 1) * block] = own[block * DIMENSIONS :]
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    vectors = sums / np.where(length > 0, length, 1)
    return vectors.astype(np.float32), (COMMON / (COMMON + counts / max(1.0, counts.sum()))).astype(np.float32)


@dataclass
class Pooling:
    """Word vectors and weights, and how texts are pooled by them."""

    vectors: np.ndarray
    weights: np.ndarray

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """Weighted mean and spread of the word vectors of each text."""
        out = []
        for some in slices(texts):
            words, count = words_of(some)
            rows = np.zeros((len(some), 2 * DIMENSIONS), np.float32)
            filled = np.flatnonzero(count)
            if len(filled):
                begin = (np.cumsum(count) - count)[filled]
                weight = self.weights[words]
                total = np.add.reduceat(weight, begin)[:, None]
                found = self.vectors[words] * weight[:, None]
                mean = np.add.reduceat(found, begin) / total
                found *= self.vectors[words]
                spread = np.add.reduceat(found, begin) / total - mean * mean
                rows[filled] = np.concatenate([mean, np.sqrt(np.maximum(spread, 0))], axis=1)
            out.append(rows)
        return np.concatenate(out) if out else np.zeros((0, 2 * DIMENSIONS), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Two layers over standardised inputs, and the temperature; or a constant, where there was nothing to learn."""

    parameters: list[np.ndarray]
    mean: np.ndarray
    deviation: np.ndarray
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        into, bias, out, last = self.parameters
        return np.maximum((pooled - self.mean) / self.deviation @ into + bias, 0) @ out + last

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return sigmoid(self.logits(pooled).astype(np.float64) / self.temperature)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy at temperature 1; ``x`` is standardised."""
        into, bias, out, last = self.parameters
        hidden = np.maximum(x @ into + bias, 0)
        error = (sigmoid(hidden @ out + last) - label) / len(x)
        back = error[:, None] * out * (hidden > 0)
        return [x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]


def cross_entropy(logit: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - label * logit))


def best_temperature(logit: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least cross-entropy between 1/20 and 20, by golden section on its logarithm."""
    low, high, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    loss = lambda t: cross_entropy(logit / np.exp(t), label)
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(pooled: np.ndarray, label: np.ndarray, seed: int = 5) -> Network:
    """A network by Adam on all but every CALIBRATION-th row, which fit the temperature."""
    mean, deviation = pooled.mean(axis=0), pooled.std(axis=0) + 1e-4
    held = np.arange(len(label)) % CALIBRATION == CALIBRATION - 1
    x, y = ((pooled - mean) / deviation)[~held], label[~held].astype(np.float32)
    r = np.random.default_rng(seed)
    shape = (pooled.shape[1], HIDDEN)
    net = Network([(r.normal(size=shape) / shape[0] ** 0.5).astype(np.float32), np.zeros(HIDDEN, np.float32), (r.normal(size=HIDDEN) / HIDDEN**0.5).astype(np.float32), np.zeros(1, np.float32)], mean, deviation)
    first, second, step = [np.zeros_like(p) for p in net.parameters], [np.zeros_like(p) for p in net.parameters], 0
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            for p, g, m, v in zip(net.parameters, net.gradients(x[some], y[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7) + DECAY * p)).astype(np.float32)
    if len(np.unique(label[held])) == 2:
        net.temperature = best_temperature(net.logits(pooled[held]).astype(np.float64), label[held])
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and text of the documents that are learned from: of each label at most MOST_LABELLED, those with the least hashes of the id."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    own = own.where(~held_out(F.col("doc_id")))
    known = materialize(own.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")), "labelled")
    taken = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy("h", "doc_id").limit(MOST_LABELLED)
        taken = some if taken is None else taken.union(some)
    # at most 2 * MOST_LABELLED ids are broadcast; of repeated rows of an id one text, the least, is learned
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taken), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Pooling, Network]:
    pooling = Pooling(*word_vectors(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2, 4 << 20):
            rows = pooling.pool(batch.column(2).to_pylist()).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "pooled"])

    rows = sample(docs, labels).mapInArrow(run, "doc_id long, label int, pooled binary").collect()
    rows.sort(key=lambda r: (int(r["doc_id"]) * 0x9E3779B97F4A7C15 % (1 << 64), r["doc_id"]))
    label = np.array([r["label"] for r in rows], np.float64)
    if len(np.unique(label)) < 2:
        return pooling, Network([], np.zeros(0), np.zeros(0), constant=float(label.mean()) if len(label) else 0.5)
    return pooling, fit(np.stack([np.frombuffer(r["pooled"], "<f4") for r in rows]), label)


_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (probability of label 1) and predicted."""
    pooling, net = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2, 4 << 20):
            found = net.score(pooling.pool(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
