"""Language identification with a convolutional network over bytes.

Windows of fixed length are cut from the whole text; filters of several widths slide
over the embedded bytes, each keeps its largest answer, and a softmax over those gives
the languages' probabilities.  The network is trained with numpy on windows of a
bounded sample of labelled texts: of each of at most MOST_LANGUAGES languages (those
with the most distinct texts) the PER_LANGUAGE distinct texts of least hash, WINDOWS
windows of each.  The weights, a few kilobytes, travel with the tasks.

Edge cases: a text that is null or has no letter is ``und`` with score 0; if nothing
is labelled, every text is; texts of any length are cut into as many windows as they
need; null labels and null texts are not learned from; a null doc_id counts as the
empty text in the fold; repeated rows give repeated results, and equal texts are
learned once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from .common import materialize, pieces_of

UNKNOWN = "und"
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANGUAGE = 400
#: So many labels, those with the most texts, are learned; what a dirty column holds besides is not.
MOST_LANGUAGES = 100
WINDOWS = 3
EPOCHS = 8
BATCH = 64
RATE = 0.01
#: A document of the corpus stays if the network is at least so sure of some language.
MIN_SCORE = 0.4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text's bytes (ASCII in lower case), the last one padded with zeros."""
    count = max(1, -(-len(data) // LENGTH))
    return _LOWER[np.frombuffer(data.ljust(count * LENGTH, b"\0"), np.uint8)].reshape(count, LENGTH)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.normal(size=shape) * 0.2).astype(np.float32)
        return cls(labels, draw(256, EMBEDDING), [draw(w * EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS, len(labels)), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def slices(self, embedded: np.ndarray, width: int) -> np.ndarray:
        """What a filter of a width sees at each place: (windows, places, width * EMBEDDING), a view."""
        n, step = embedded.strides[0], embedded.strides[1]
        shape = (len(embedded), LENGTH - width + 1, width * EMBEDDING)
        return np.lib.stride_tricks.as_strided(embedded, shape, (n, step, embedded.strides[2]), writeable=False)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Embedded bytes, the filters' largest answers (not below 0), and where they are."""
        embedded = np.ascontiguousarray(self.embedding[windows])
        best, places = [], []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            seen = self.slices(embedded, width)
            answers = (seen.reshape(-1, width * EMBEDDING) @ weights).reshape(len(windows), -1, FILTERS)
            best.append(answers.max(axis=1) + bias)
            places.append(answers)
        return embedded, np.maximum(np.concatenate(best, axis=1), 0), places

    def predict(self, windows: np.ndarray, at_once: int = 64) -> np.ndarray:
        """Probabilities (windows, languages).

        A filter's answer is a sum of one term per byte under it, so the terms are
        looked up by byte; windows run along the second axis, so that the largest
        answers are taken over whole rows.
        """
        tables = [[self.embedding @ weights[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(width)] for width, weights in zip(WIDTHS, self.filters, strict=True)]
        out, term = [], np.empty((LENGTH, at_once, FILTERS), np.float32)
        for at in range(0, len(windows), at_once):
            read = windows[at : at + at_once].T.astype(np.intp)
            some, pooled = read.shape[1], []
            for width, terms, bias in zip(WIDTHS, tables, self.biases, strict=True):
                places = LENGTH - width + 1
                answers = terms[0][read[:places]]
                for k in range(1, width):
                    if some == at_once:
                        answers += np.take(terms[k], read[k : k + places], axis=0, out=term[:places], mode="clip")
                    else:
                        answers += terms[k][read[k : k + places]]
                pooled.append(answers.max(axis=0) + bias)
            out.append(softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.out_bias))
        return np.concatenate(out)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        embedded, pooled, answers = self.pooled(windows)
        rows = np.arange(len(windows))
        error = softmax(pooled @ self.out + self.out_bias)
        error[rows, target] -= 1
        error /= len(windows)
        back = (error @ self.out.T) * (pooled > 0)
        d_embedding, d_filters, d_biases = np.zeros_like(self.embedding), [], []
        for n, width in enumerate(WIDTHS):
            grad = back[:, n * FILTERS : (n + 1) * FILTERS]
            place = answers[n].argmax(axis=1)  # (windows, filters)
            seen = self.slices(embedded, width)[rows[:, None], place]  # (windows, filters, width * EMBEDDING)
            d_filters.append(np.einsum("nfk,nf->kf", seen, grad))
            d_biases.append(grad.sum(axis=0))
            into = (grad[:, :, None] * self.filters[n].T[None]).reshape(len(windows), FILTERS, width, EMBEDDING)
            read = windows[rows[:, None, None], place[:, :, None] + np.arange(width)]
            np.add.at(d_embedding, read.ravel(), into.reshape(-1, EMBEDDING))
        return [d_embedding, *d_filters, *d_biases, pooled.T @ error, error.sum(axis=0)]


def fit(windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """A network trained by Adam on (windows, indices into labels)."""
    net, r = Network.fresh(labels), np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            for p, g, m, v in zip(net.parameters(), net.gradients(windows[some], target[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label indices and labels of the bounded sample that the network learns from."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    texts = materialize(labelled.select("lang", "h").distinct(), "texts")  # copies of a text count once
    known = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).select("lang")
    ranked = texts.join(F.broadcast(known), "lang").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("rank") <= per_language).select("lang", "h")  # at most per_language * MOST_LANGUAGES rows
    sampled = labelled.join(F.broadcast(chosen), ["lang", "h"])
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2):
            rows = []
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    all_of = windows_of(text.encode())
                    rows.append((lang, h, all_of[np.unique(np.linspace(0, len(all_of) - 1, WINDOWS).astype(int))].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = sampled.mapInArrow(run, "lang string, h long, windows binary").groupBy("lang", "h").agg(F.min("windows").alias("windows")).collect()
    kept: dict[str, list[bytes]] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["h"])):
        kept.setdefault(row["lang"], []).append(row["windows"])
    labels = sorted(kept)
    windows = [np.frombuffer(b"".join(kept[x]), np.uint8).reshape(-1, LENGTH) for x in labels]
    return np.concatenate(windows) if windows else np.zeros((0, LENGTH), np.uint8), np.repeat(np.arange(len(labels)), [len(w) for w in windows]), labels


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """The network for a table of documents; None if nothing is labelled."""
    windows, target, labels = training_windows(docs, per_language)
    return fit(windows, target, labels) if labels else None


def classify(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and probability of each text: the mean over all of its windows, weighted by the bytes in them."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
    if not known:
        return out
    data = [texts[i].encode() for i in known]
    windows = [windows_of(d) for d in data]
    probability = net.predict(np.concatenate(windows))
    at = 0
    for i, d, w in zip(known, data, windows, strict=True):
        weight = np.full(len(w), LENGTH, float)
        weight[-1] = len(d) - LENGTH * (len(w) - 1)
        mean = weight @ probability[at : at + len(w)] / weight.sum()
        at += len(w)
        best = int(mean.argmax())
        out[i] = (net.labels[best], min(1.0, float(mean[best])))
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score."""
    net = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 2, 2 << 20):
            lang, score = zip(*classify(net, batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score)], schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_filter(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents (all their columns, whatever their names) in some language that the network is at least ``min_score`` sure of.

    Null texts and texts without a letter go; repeated rows stay or go alike; if nothing is labelled, no document stays.
    """
    net = train(docs)

    def sure(text: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(text), 256):  # a slice at a time: a batch of long texts is never in Python all at once
            out += [lang != UNKNOWN and score >= min_score for lang, score in classify(net, text.slice(at, 256).to_pylist())]
        return pa.array(out, pa.bool_())

    return docs.where(F.arrow_udf(sure, BooleanType())(F.col("text")))
