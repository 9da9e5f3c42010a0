"""A quality classifier on word vectors by random indexing.

Words are hashed to VOCAB entries. Each entry has a fixed sparse random index vector, and its context vector is the sum
of the index vectors of the words within REACH places, over the whole corpus. A text is pooled into the mean and spread
of its words' normalised context vectors and the size of the steps between neighbours. A network of two layers, trained
in numpy on at most SAMPLE labelled rows and stopped by a part of them, gives the probability of label 1; on that part a
temperature calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import chunks, empty_text
from .quality_rules import Texts, _words

VOCAB, SIZE, NONZERO, REACH = 1 << 14, 64, 4, 2
SEED = 20
#: Labelled rows used for training at most, those whose doc_id has the smallest hash.
SAMPLE = 30_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 2e-3, 3e-4
FOLDS = 5
CUTOFF = 0.3
#: Words pooled at a time.
SLICE = 1 << 16


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each entry the places that are not zero, and their signs."""
    random = np.random.default_rng(SEED)
    places = np.argsort(random.random((VOCAB, SIZE)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), np.where(random.random((VOCAB, NONZERO)) < 0.5, -1.0, 1.0)


def entries(own: Texts) -> np.ndarray:
    return np.array(_words.hashes, np.int64)[own.ids] % VOCAB


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised context vector of each entry, from all texts of docs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(VOCAB * SIZE)
        for batch in chunks(batches):
            own = Texts(empty_text(batch.column(0).to_pylist()))
            word = entries(own)
            for a in range(0, word.size, SLICE):
                b = min(word.size, a + SLICE)
                for k in range(1, REACH + 1):
                    same = np.flatnonzero(own.doc[a : b - k] == own.doc[a + k : b]) + a if b - a > k else np.array([], np.int64)
                    for x, y in ((word[same], word[same + k]), (word[same + k], word[same])):
                        total += np.bincount((x[:, None] * SIZE + places[y]).ravel(), weights=signs[y].ravel(), minlength=VOCAB * SIZE)
        yield from blocks.emit(np.rint(total).astype(np.int64), 64)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(kernel, blocks.SCHEMA)
    vectors = blocks.summed(rows, 64, VOCAB * SIZE).reshape(VOCAB, SIZE).astype(float)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """3 * SIZE features of each text; zero for a text without words."""
    own = Texts(texts)
    word, m = entries(own), len(texts)
    sums = np.zeros((3, m, SIZE))
    for a in range(0, word.size, SLICE):
        doc = own.doc[a : a + SLICE]
        x = vectors[word[a : a + SLICE]]
        step = x - vectors[word[max(a - 1, 0) : a + doc.size - 1]] if a else np.concatenate((np.zeros((1, SIZE), np.float32), x[1:] - x[:-1]))
        first = np.concatenate(([a == 0 or own.doc[a - 1] != doc[0]], doc[1:] != doc[:-1]))
        step[first] = 0
        starts = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
        for i, values in enumerate((x, x * x, step * step)):
            sums[i, doc[starts]] += np.add.reduceat(values, starts, axis=0)
    n = np.maximum(own.n_words, 1)[:, None]
    mean, square, steps = sums / n
    return np.concatenate((mean, np.sqrt(np.maximum(square - mean**2, 0)), np.sqrt(steps)), axis=1).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if y.size else 0.0


class Network:
    """Two layers, tanh and a logit, on standardised features; probability() divides the logit by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray):
        """x and y: rows with labels 0 and 1; check: which of them stop the training and set the temperature."""
        self.mean, self.scale, self.temperature = np.zeros(x.shape[1]), np.ones(x.shape[1]), 1.0
        if len(x):
            self.mean, self.scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-6
        random = np.random.default_rng(SEED)
        d = x.shape[1]
        self.layers = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        if not len(y) or check.all():
            return
        z = (x - self.mean) / self.scale
        fit, own, seen, own_seen = z[~check], y[~check], z[check], y[check]
        best, least = self.layers, np.inf
        first, second, round_ = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(EPOCHS):
            order = random.permutation(len(own))
            for at in range(0, len(own), BATCH):
                rows = order[at : at + BATCH]
                round_ += 1
                for i, g in enumerate(self.gradients(fit[rows], own[rows])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    change = RATE * first[i] / (1 - 0.9**round_) / (np.sqrt(second[i] / (1 - 0.999**round_)) + 1e-8)
                    self.layers[i] = self.layers[i] - change
            now = loss(self.logit(seen), own_seen) if own_seen.size else -round_
            if now < least:
                best, least = list(self.layers), now
        self.layers = best
        if own_seen.size:
            logits = self.logit(seen)
            self.temperature = min(np.geomspace(0.25, 8, 141), key=lambda t: loss(logits / t, own_seen))

    def logit(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(z @ a + b) @ c + d[0]

    def gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, _ = self.layers
        h = np.tanh(z @ a + b)
        d = (sigmoid(self.logit(z)) - y) / len(y)
        g = np.outer(d, c) * (1 - h * h)
        return [z.T @ g + DECAY * a, g.sum(axis=0), h.T @ d + DECAY * c, np.array([d.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit((x - self.mean) / self.scale) / self.temperature)


def remainder(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
    """A network from at most SAMPLE labelled rows whose remainder is not 0, those of the smallest digest. An id with both
    labels or none is left out."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    marks = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    marks = marks.where("y = z").where(remainder("__id", FOLDS) != 0).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    marks = marks.select("__id", "y", (remainder("__id", FOLDS) == 1).alias("checks"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = pooled(empty_text(batch.column(0).to_pylist()), held.value)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1), batch.column(2), batch.column(3)], names=["x", "y", "checks", "order"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("__id"))
    rows = rows.select("text", F.col("y").cast("int").alias("y"), "checks", F.xxhash64("doc_id", "text").alias("order"))
    features = rows.mapInArrow(kernel, "x binary, y int, checks boolean, order long")
    found = features.orderBy("order").limit(SAMPLE).toArrow()  # an id may stand on any number of rows
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, 3 * SIZE)
    return Network(x, found["y"].to_numpy().astype(float), found["checks"].to_numpy().astype(bool))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (its labels were not used), score (the probability of label 1) and predicted (score >= CUTOFF).

    Null texts count as empty, and empty ones get the score of no features. A null doc_id is never held out and never
    trained on. Without labels every score is that of the untrained network. Repeated rows stay repeated; columns other
    than doc_id and text are not looked at; an empty table gives an empty result.
    """
    vectors = word_vectors(docs)
    context = docs.sparkSession.sparkContext
    held = context.broadcast((vectors, train(docs, labels, vectors)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in chunks(batches):
            p = network.probability(pooled(empty_text(batch.column(1).to_pylist()), vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"doc_id {kind}, held_out boolean, score double, predicted int")
