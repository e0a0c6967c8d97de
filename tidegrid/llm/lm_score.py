"""Language-model scores by masked pseudo-likelihood.

Each word of a text is predicted from the ``WINDOW`` words on both of its sides, and the conditional log-probabilities
are summed. Words are hashed into ``buckets``. The network adds an embedding of every word on the left and one of every
word on the right, squashes the sum, and gives probabilities to ``classes`` classes of words; classes cut the
buckets, ordered by frequency, into shares of about equal mass. Within a class a word has its smoothed share of the
corpus, so that P(word | both sides) = P(class | both sides) * P(word | class) is a true distribution.

Three passes over all documents: bucket counts (summed inside tasks, then by a grouped sum); training, where every task
starts from the same seeded parameters, goes through all words of its partition with Adagrad in numpy, and sends its
parameters in pieces that are averaged in two steps, weighted by words; and scoring with the average broadcast.
What is broadcast is ``buckets`` x ``size`` numbers, whatever the size of the corpus.

Defined results: null and empty texts have no words, a log-probability of 0 and no mean. Repeated rows train and are
scored as often as they occur; extra columns are ignored. Long texts pass through in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 2

#: Words in a training step; words scored at once; numbers in a row of parameters.
STEP, BATCH, PIECE = 8192, 1 << 15, 1 << 14


@dataclass(frozen=True)
class Shape:
    """Sizes of the network; ``rate`` is Adagrad's."""

    buckets: int = 1 << 13
    size: int = 16
    classes: int = 32
    rate: float = 0.05
    seed: int = 7

    def start(self) -> np.ndarray:
        """Seeded parameters: left and right embeddings (one more row for the edge of a text), weights, biases."""
        draw = np.random.default_rng(self.seed)
        many = 2 * (self.buckets + 1) * self.size + self.size * self.classes
        return np.r_[draw.normal(0, 0.1, many), np.zeros(self.classes)].astype(np.float32)

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Views of the parameters."""
        rows, a = self.buckets + 1, (self.buckets + 1) * self.size
        b = 2 * a + self.size * self.classes
        return flat[:a].reshape(rows, -1), flat[a : 2 * a].reshape(rows, -1), flat[2 * a : b].reshape(self.size, -1), flat[b:]


def word_buckets(text: bytes, buckets: int) -> np.ndarray:
    """The bucket of each word, capitals A to Z taken as small letters."""
    words = text.lower().split()
    return (np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(buckets)).astype(np.int64)


def word_classes(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's class, and its log-probability within the class."""
    mass = counts + 0.5
    order = np.argsort(-mass, kind="stable")
    before = np.cumsum(mass[order]) - mass[order]
    of = np.empty(len(counts), np.int64)
    of[order] = np.minimum((before / mass.sum() * classes).astype(np.int64), classes - 1)
    total = np.bincount(of, weights=mass, minlength=classes)
    return of, np.log(mass) - np.log(total[of])


def stream(texts: list[np.ndarray], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with edges between them, and the places of their words."""
    gap = np.full(WINDOW, edge)
    joined = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    return joined, np.flatnonzero(joined != edge)


def hidden(left: np.ndarray, right: np.ndarray, joined: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = left[joined[at - 1]] + right[joined[at + 1]]
    for k in range(2, WINDOW + 1):
        total += left[joined[at - k]]
        total += right[joined[at + k]]
    return np.tanh(total)


def class_scores(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log-probabilities of the classes."""
    z = h @ weights + bias
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


class Trainer:
    """Adagrad over the words of one partition."""

    def __init__(self, shape: Shape, classes: np.ndarray):
        self.shape, self.classes = shape, classes
        self.flat = shape.start()
        self.past = np.full(len(self.flat), 1e-3, np.float32)
        self.left, self.right, self.weights, self.bias = shape.parts(self.flat)
        self.past_left, self.past_right, self.past_weights, self.past_bias = shape.parts(self.past)
        self.words = 0

    def _rows(self, table: np.ndarray, past: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total = np.add.reduceat(grad[order], first, axis=0)
        own = own[first]
        past[own] += total * total
        table[own] -= self.shape.rate * total / np.sqrt(past[own])

    def step(self, joined: np.ndarray, at: np.ndarray) -> None:
        h = hidden(self.left, self.right, joined, at)
        slope = np.exp(class_scores(h, self.weights, self.bias))
        slope[np.arange(len(at)), self.classes[joined[at]]] -= 1
        slope /= np.float32(len(at)) ** 0.5
        back = (slope @ self.weights.T) * (1 - h * h)
        for grad, own, past in ((h.T @ slope, self.weights, self.past_weights), (slope.sum(axis=0), self.bias, self.past_bias)):
            past += grad * grad
            own -= self.shape.rate * grad / np.sqrt(past)
        both = np.concatenate([back] * WINDOW)
        self._rows(self.left, self.past_left, np.concatenate([joined[at - k] for k in range(1, WINDOW + 1)]), both)
        self._rows(self.right, self.past_right, np.concatenate([joined[at + k] for k in range(1, WINDOW + 1)]), both)
        self.words += len(at)

    def learn(self, texts: list[np.ndarray]) -> None:
        joined, places = stream(texts, self.shape.buckets)
        for a in range(0, len(places), STEP):
            self.step(joined, places[a : a + STEP])


def _batches(column: pa.Array, buckets: int, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, bucketed texts) with about so many words at a time."""
    start, texts, total = 0, [], 0
    for i, text in enumerate(column.cast(pa.binary())):
        texts.append(word_buckets(text.as_py() if text.is_valid else b"", buckets))
        total += len(texts[-1])
        if total >= words:
            yield start, texts
            start, texts, total = i + 1, [], 0
    if texts:
        yield start, texts


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _batches(batch.column(0), buckets, BATCH):
                total += np.bincount(np.concatenate(texts), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for piece, words, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w, total = sums.get(piece, (0.0, 0.0))
            sums[piece] = w + words, total + np.frombuffer(values, np.float64)
    keys = sorted(sums)
    cols = [pa.array(keys, pa.int64()), pa.array([sums[k][0] for k in keys], pa.float64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, ["piece", "words", "values"])


def train(docs: DataFrame, shape: Shape, classes: np.ndarray) -> np.ndarray:
    """The average of the parameters that the tasks arrive at, weighted by their words."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shape, classes)
        for batch in batches:
            for _, texts in _batches(batch.column(0), shape.buckets, 4 * STEP):
                trainer.learn(texts)
        if trainer.words:
            sums = trainer.flat.astype(np.float64) * trainer.words
            pieces = [sums[i : i + PIECE].tobytes() for i in range(0, len(sums), PIECE)]
            words = np.full(len(pieces), float(trainer.words))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array(words), pa.array(pieces, pa.binary())], ["piece", "words", "values"])

    kind = "piece long, words double, values binary"
    sent = docs.select("text").mapInArrow(learn, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    partly = sent.repartition("piece", "salt").select("piece", "words", "values").mapInArrow(_sum_pieces, kind)
    rows = partly.repartition("piece").mapInArrow(_sum_pieces, kind).collect()
    if not rows:
        return shape.start()
    return np.concatenate([np.frombuffer(bytes(r["values"])) / r["words"] for r in sorted(rows, key=lambda r: r["piece"])]).astype(np.float32)


@dataclass
class LanguageModel:
    shape: Shape
    flat: np.ndarray
    classes: np.ndarray
    within: np.ndarray

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The summed log-probabilities of bucketed texts."""
        left, right, weights, bias = self.shape.parts(self.flat)
        joined, at = stream(texts, self.shape.buckets)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        out = np.zeros(len(texts))
        for a in range(0, len(at), STEP):
            some = at[a : a + STEP]
            word = joined[some]
            scores = class_scores(hidden(left, right, joined, some), weights, bias)
            each = scores[np.arange(len(some)), self.classes[word]] + self.within[word]
            out += np.bincount(of[a : a + STEP], weights=each, minlength=len(texts))
        return out


def fit(docs: DataFrame, shape: Shape = Shape(), text_col: str = "text") -> LanguageModel:
    """A model of all texts of ``docs``."""
    texts = docs.select(F.col(text_col).alias("text"))
    classes, within = word_classes(bucket_counts(texts, shape.buckets), shape.classes)
    return LanguageModel(shape, train(texts, shape, classes), classes, within)


def score_column(text: Column, model: LanguageModel, session: SparkSession) -> Column:
    """A struct of words and summed log-probability of each text."""
    shared = session.sparkContext.broadcast((model.shape, model.flat, model.classes, model.within))

    @F.arrow_udf("n_tokens long, log_prob double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            words, sums = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for start, texts in _batches(batch, own.shape.buckets, BATCH):
                rows = slice(start, start + len(texts))
                words[rows] = [len(t) for t in texts]
                sums[rows] = own.score(texts)
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(sums)], ["n_tokens", "log_prob"])

    return scores(text)


def pseudo_likelihood(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, words, summed log-probability, and its mean per word."""
    model = fit(docs, shape, text_col)
    found = docs.select(F.col(id_col), score_column(F.col(text_col), model, docs.sparkSession).alias("s")).select(id_col, "s.n_tokens", "s.log_prob")
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
