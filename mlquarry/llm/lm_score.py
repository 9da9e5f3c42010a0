"""Scoring texts by a log-bilinear language model.

Counting covers every training text: each token's count, how often each class follows each pair of classes, and how often
each output follows each class. Outputs are the OUT most frequent tokens, one by one, and TAIL classes of endings for all
others, since the vocabulary has no bound; such a token's probability is that of its class times its share of the class.
The context is the two tokens before as classes, of which the TOP most frequent tokens have one each. The model is
log-bilinear: the vectors of the two classes, each weighed by its place, are added and multiplied with the vector of the
output to come, plus its bias. It is trained in numpy with noise-contrastive estimation on draws from the whole counts,
the more the more tokens there are. One batched matrix product over all contexts and outputs then gives the sums that
normalise the log-probabilities.

Counts of the KNOWN most frequent tokens are broadcast; the texts' other tokens meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import chunks, cut, empty_text

FOLDS, HELD_OUT = 7, 2
#: The end of a text; no word is a line end.
END = b"\n"
TOP, TAIL, OUT = 64, 64, 8192
CLASSES = TOP + TAIL
#: Tokens whose counts every worker holds.
KNOWN = 50_000
#: Distinct tokens after which a task passes its counts on, and tokens beyond the known ones that a worker remembers.
FLUSH, MEMORY = 60_000, 100_000
SIZE, BATCH, NOISE, RATE, SEED = 32, 2048, 128, 0.003, 7
#: Rounds of training, and how many more for every doubling of the tokens from MILLION on.
ROUNDS, MORE_ROUNDS, MILLION = 1500, 200, 1_000_000
#: Contexts multiplied with all outputs at a time.
CONTEXTS = 512
SIGNS = b".,;:!?"


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, and one END."""
    return [*text.encode().lower().split(), END]


def tail_class(token: bytes) -> int:
    """The class of a token that has none of its own, by its last two bytes before closing punctuation."""
    return TOP + zlib.crc32((token.rstrip(SIGNS) or token)[-2:]) % TAIL


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text modulo FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): how often each token occurs in docs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])
            found.clear()
            return out

        found: Counter[bytes] = Counter()
        for batch in chunks(batches):
            for text in empty_text(batch.column(0).to_pylist()):
                found.update(tokens(text))
                if len(found) > FLUSH:
                    yield rows()
        if found:
            yield rows()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(kernel, "token binary, c long")
    return counted.groupBy("token").agg(F.sum("c").alias("c"))


class Known(dict):
    """Tokens to small ids with the class, output and log10(count + 1) of each; the counts of what is not among the known
    ones are not here. Outputs are the TAIL classes of endings, then OUT known tokens."""

    def __init__(self, known: list[tuple[bytes, int]]):
        super().__init__((t, i) for i, (t, _) in enumerate(known))
        self.known = len(known)
        self.names = [t for t, _ in known]
        self.classes = [i if i < TOP else tail_class(t) for i, (t, _) in enumerate(known)]
        self.outputs = [TAIL + i if i < OUT else tail_class(t) - TOP for i, (t, _) in enumerate(known)]
        self.logs = np.log10(np.array([c for _, c in known], float) + 1)

    def __missing__(self, token: bytes) -> int:
        self[token] = found = len(self.names)
        self.names.append(token)
        self.classes.append(k := tail_class(token))
        self.outputs.append(k - TOP)
        return found

    def forget(self) -> None:
        if len(self.names) > self.known + MEMORY:
            for token in self.names[self.known :]:
                del self[token]
            del self.names[self.known :], self.classes[self.known :], self.outputs[self.known :]


class Network(NamedTuple):
    """queries: a vector for each context; vectors and bias of each output; sums: ln of the sum over outputs for each context."""

    queries: np.ndarray
    vectors: np.ndarray
    bias: np.ndarray
    sums: np.ndarray

    def log10(self, context: np.ndarray, output: np.ndarray) -> np.ndarray:
        """log10 of the probability of outputs after contexts."""
        scores = np.einsum("ij,ij->i", self.queries[context], self.vectors[output]) + self.bias[output]
        return (scores - self.sums[context]) / np.log(10)


class Model(NamedTuple):
    """known: tokens and counts, most frequent first; total and distinct tokens; shares: for each output log10 of what its
    tokens' counts + 1 are shares of; network: the probabilities of outputs."""

    known: list[tuple[bytes, int]]
    total: int
    distinct: int
    shares: np.ndarray
    network: Network


def contexts(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two classes before each token as one number; before a text stand two ENDs, whose class is 0."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts] = two[starts] = 0
    two[(starts + 1)[starts + 1 < classes.size]] = 0
    return two * CLASSES + one


def class_counts(docs: DataFrame, known: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """How often each class follows each context, as a matrix of CLASSES ** 2 rows, and each output each class before it."""
    held = docs.sparkSession.sparkContext.broadcast(known)
    outputs = TAIL + min(OUT, len(known))
    width = CLASSES**2 + outputs

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Known(held.value), np.zeros((CLASSES, width), np.int64)
        for batch in chunks(batches):
            lookup.forget()
            split = [tokens(t) for t in empty_text(batch.column(0).to_pylist())]
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter((lookup[t] for x in split for t in x), np.int64, int(lengths.sum()))
            classes, out = np.array(lookup.classes, np.int64)[ids], np.array(lookup.outputs, np.int64)[ids]
            context = contexts(classes, np.cumsum(lengths) - lengths)
            two, one = np.divmod(context, CLASSES)
            for row, column in ((two, one * CLASSES + classes), (one, CLASSES**2 + out)):
                at, n = np.unique(row * width + column, return_counts=True)
                total.reshape(-1)[at] += n
        yield from blocks.emit(total, CLASSES)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(kernel, blocks.SCHEMA)
    found = blocks.summed(rows, CLASSES, CLASSES * width).reshape(CLASSES, width)
    return found[:, : CLASSES**2].reshape(CLASSES**2, CLASSES), found[:, CLASSES**2 :]


def log_bilinear(counts: np.ndarray, pairs: np.ndarray, classes: np.ndarray) -> Network:
    """A log-bilinear model trained with noise-contrastive estimation on draws from counts: a context with the class to
    come from counts, then an output of this class from pairs, the counts of outputs after the last class.

    classes: the class of each output; a class of endings has an output of its own and those of its frequent tokens.
    """
    random = np.random.default_rng(SEED)
    flat, outputs, tokens_ = np.flatnonzero(counts), len(classes), int(counts.sum())
    seen = pairs.sum(axis=0)
    noise = (seen + 1.0) / (seen.sum() + outputs)
    a, b = random.normal(0, 0.1, (2, CLASSES, SIZE)).astype(np.float32)
    vectors = [a, b, np.zeros((outputs, SIZE), np.float32), np.log(noise).astype(np.float32)]
    if flat.size:
        mass, spread, log_noise = np.cumsum(counts.reshape(-1)[flat]), np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        order = np.argsort(classes, kind="stable")  # outputs by class, so that a class after a class is a range of ranks
        ranks = np.concatenate(([0], np.cumsum(pairs[:, order].reshape(-1))))
        begin, end = (np.searchsorted(classes[order], np.arange(CLASSES), side=x) for x in ("left", "right"))
        first, second = [np.zeros_like(p) for p in vectors], [np.zeros_like(p) for p in vectors]
        hot = np.eye(CLASSES, dtype=np.float32)
        rounds = ROUNDS + int(MORE_ROUNDS * max(0.0, np.log2(tokens_ / MILLION)))
        for round_ in range(1, rounds + 1):
            drawn = flat[np.searchsorted(mass, random.integers(0, mass[-1], BATCH), side="right")]
            context, kind = np.divmod(drawn, CLASSES)
            two, one = np.divmod(context, CLASSES)
            low, high = ranks[one * outputs + begin[kind]], ranks[one * outputs + end[kind]]
            rank = low + (random.random(BATCH) * (high - low)).astype(np.int64)
            word = order[(np.searchsorted(ranks, rank, side="right") - 1) % outputs]
            other = np.minimum(np.searchsorted(spread, random.random(NOISE)), outputs - 1)
            a, b, out, bias = vectors
            q = a[two] + b[one]
            own = np.einsum("ij,ij->i", q, out[word]) + bias[word] - log_noise[word]
            false = q @ out[other].T + bias[other] - log_noise[other]
            d_own, d_false = (1 / (1 + np.exp(-own)) - 1) / np.float32(BATCH), 1 / (1 + np.exp(-false)) / np.float32(BATCH)
            d_q = d_false @ out[other] + d_own[:, None] * out[word]
            d_out, d_bias = np.zeros_like(out), np.zeros_like(bias)
            np.add.at(d_out, word, d_own[:, None] * q)
            np.add.at(d_out, other, d_false.T @ q)
            np.add.at(d_bias, word, d_own)
            np.add.at(d_bias, other, d_false.sum(axis=0))
            rate = np.float32(RATE * min(1.0, 2 * (1 - round_ / (rounds + 1))))
            for i, g in enumerate((hot[two].T @ d_q, hot[one].T @ d_q, d_out, d_bias)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                vectors[i] = vectors[i] - rate * first[i] / (1 - 0.9**round_) / (np.sqrt(second[i] / (1 - 0.999**round_)) + 1e-8)
    a, b, out, bias = vectors
    queries = (a[:, None, :] + b[None, :, :]).reshape(-1, SIZE)
    sums = np.empty(len(queries))
    for at in range(0, len(queries), CONTEXTS):
        scores = (queries[at : at + CONTEXTS] @ out.T + bias).astype(float)
        most = scores.max(axis=1)
        sums[at : at + CONTEXTS] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    return Network(queries, out, bias, sums)


def trained(spark: SparkSession, counts: np.ndarray, pairs: np.ndarray, classes: np.ndarray) -> Network:
    """log_bilinear() in one task: workers keep to one thread, and the driver holds no training state."""
    held = spark.sparkContext.broadcast((counts, pairs, classes))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            made = log_bilinear(*held.value)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64 if i == 3 else np.float32).tobytes()], pa.binary()) for i, x in enumerate(made)], names=list(Network._fields))

    found = spark.range(1, numPartitions=1).mapInArrow(kernel, ", ".join(f"{f} binary" for f in Network._fields)).toArrow()
    queries, vectors, bias = (np.frombuffer(found[f][0].as_py(), np.float32) for f in Network._fields[:3])
    return Network(queries.reshape(-1, SIZE), vectors.reshape(-1, SIZE), bias, np.frombuffer(found["sums"][0].as_py()))


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """END, then at most KNOWN tokens and their counts, most frequent first: all from the least size on that leaves no more.

    Sizes are sixteenths of a power of two, so the driver sees a few hundred numbers before it takes the tokens.
    """
    size = F.floor(F.log2("c") * 16)
    sizes = sorted(((r.size, r.n) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = float("inf"), 0
    for at, more in sizes:
        n += more
        if n > KNOWN:
            break
        least = at
    found = counts.where((size >= F.lit(float(least))) | (F.col("token") == F.lit(END))).toArrow()
    pairs = zip(found["token"].to_pylist(), found["c"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: (x[0] != END, -x[1], x[0]))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs and the counts (token, c) of all their tokens."""
    counts = cut(token_counts(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = most_frequent(counts)
    lookup = Known(known)
    single = docs.sparkSession.sparkContext.broadcast({t for t, _ in known[:OUT]})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = single.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([-1 if t in own else tail_class(t) - TOP for t in names], pa.int32()), batch.column(1)], names=["k", "c"])

    classed = counts.mapInArrow(kernel, "k int, c long").where("k >= 0").groupBy("k").agg((F.sum("c") + F.count("*")).alias("n"))
    sizes = np.zeros(TAIL)
    for row in classed.collect():  # at most TAIL rows
        sizes[row.k] = row.n
    n = min(OUT, len(known))
    classes = np.array([*range(TOP, CLASSES), *lookup.classes[:n]])
    network = trained(docs.sparkSession, *class_counts(docs, known), classes)
    return Model(known, int(total), int(distinct), np.concatenate((np.log10(sizes + 1), lookup.logs[:n])), network), counts


def score_with(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; a column held_out passes through."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in docs.columns if c == "held_out"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        lookup, nth = Known(own.known), TaskContext.get().partitionId() << 40
        for batch in chunks(batches):
            lookup.forget()
            split = [tokens(t) for t in empty_text(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter((lookup[t] for x in split for t in x), np.int64, int(n.sum()))
            doc, starts = np.repeat(np.arange(n.size), n), np.cumsum(n) - n
            classes, out = np.array(lookup.classes, np.int64)[ids], np.array(lookup.outputs, np.int64)[ids]
            logs = own.network.log10(contexts(classes, starts), out) - own.shares[out]
            sure = ids < lookup.known
            head = np.bincount(doc[sure], weights=lookup.logs[ids[sure]], minlength=n.size)
            rare = ids[~sure] - lookup.known
            pair, times = np.unique(doc[~sure] << 32 | rare, return_counts=True)
            ends = np.cumsum(np.bincount(pair >> 32, minlength=n.size))
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            names = pa.array([lookup.names[lookup.known + i] for i in (pair & 0xFFFFFFFF).tolist()], pa.binary())
            columns = {
                "uid": nth + np.arange(n.size),
                "n_tokens": n,
                "head_known": np.bincount(doc[sure], minlength=n.size),
                "head": head,
                "logs": np.bincount(doc, weights=logs, minlength=n.size),
            }
            nth += n.size
            passed = [batch.column(i) for i in (0, *range(2, batch.num_columns))]
            lists = [pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times))]
            yield pa.RecordBatch.from_arrays([*passed, *[pa.array(v) for v in columns.values()], *lists], names=["doc_id", *extra, *columns, "rare", "times"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *extra)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {'held_out boolean, ' if extra else ''}uid long, n_tokens long, head_known long, head double, logs double, rare array<binary>, times array<long>"
    placed = cut(rows.mapInArrow(kernel, schema))
    rare = placed.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    # a token outside the known ones is rare in training; Spark splits one that is not so in the texts, both sides being plain
    found = rare.join(counts, "token").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail"))
    all_known = F.col("head_known") + F.coalesce("more", F.lit(0))
    plus = F.col("head") + F.coalesce("tail", F.lit(0.0))
    base = plus - F.col("n_tokens") * F.log10(F.lit(model.total + 1.0 * (model.distinct + 1)))
    return placed.join(found, "uid", "left").select(
        "doc_id", *extra, "n_tokens", all_known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (plus + F.col("logs")).alias("score")
    )


def score(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those that are not held out (see held_out), with the columns of score_with.

    Null texts count as empty: one END. A null doc_id is trained on. Repeated rows stay repeated and count as often as
    they stand there. Without training texts the model is the untrained one and no token is known. Columns other than
    doc_id and text are not looked at; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    model, counts = train(rows.where(~F.col("held_out")))
    return score_with(rows, model, counts)
