"""Vocabularies and term matrices, sparse in long form (id, term, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, words_by_space
from ..storage import cut
from .encoding import sized
from .ranking import numbered


#: Terms that tasks look up in a text's words; a larger vocabulary is joined. Words that a task looks up at a time.
LOOKED_UP, WORDS = 100_000, 1_000_000
#: Numbers of a vector that one aggregation takes the means of.
MEANS = 300


def term_list(text: str, lowercase: bool = True, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    words = words_by_space(F.lower(text) if lowercase else F.col(text))
    low, high = ngram_range
    lists = [ngrams(words, n) if n > 1 else words for n in range(low, high + 1)]
    return F.concat(*lists) if len(lists) > 1 else lists[0]


def terms(docs: DataFrame, id_col: str, text: str, lowercase: bool = True, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(id, term) of every occurrence."""
    return docs.select(id_col, F.explode(term_list(text, lowercase, ngram_range)).alias("term"))


def term_counts(docs: DataFrame, id_col: str, text: str, **how) -> DataFrame:
    """(id, term, n)."""
    return terms(docs, id_col, text, **how).groupBy(id_col, "term").agg(F.count("*").alias("n"))


def top_terms(weights: DataFrame, weight: str, max_features: int | None) -> DataFrame:
    """The terms of largest weight, ties in order of the term."""
    return weights if max_features is None else weights.orderBy(F.desc(weight), "term").limit(max_features)


def vocabulary(docs: DataFrame, id_col: str, text: str, max_vocab_size: int | None = 10_000, min_freq: int = 1, tokens: Column | None = None) -> DataFrame:
    """(term, n, idx): the most frequent terms (None: all), numbered from 0 by frequency and then by term."""
    source = docs.select(F.explode(tokens).alias("term")) if tokens is not None else terms(docs, id_col, text)
    counts = source.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq)
    if max_vocab_size is None:
        return numbered(counts, [-F.col("n"), "term"], "idx")
    best = top_terms(counts, "n", max_vocab_size)  # bounded, so one task may number it
    return best.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "term")) - 1)


def encode(docs: DataFrame, id_col: str, tokens: Column, vocab: DataFrame, unknown: str | None = None, pad_to_length: int | None = None) -> DataFrame:
    """(id, ids): each text's tokens as vocabulary numbers, in order.

    Tokens outside the vocabulary are dropped, or get the number of the term unknown if the vocabulary has it. With
    pad_to_length, arrays are filled with 0 or cut.
    """
    placed = docs.select(id_col, F.posexplode_outer(tokens).alias("pos", "term"))
    numbers = sized(vocab.select("term", "idx"))
    joined = placed.join(numbers, "term", "left")
    if unknown is not None:
        default = vocab.where(F.col("term") == unknown).select("idx").first()
        if default:
            joined = joined.withColumn("idx", F.coalesce("idx", F.when(F.isnotnull("term"), F.lit(default[0]))))
    ordered = F.array_sort(F.collect_list(F.when(F.isnotnull("idx"), F.struct("pos", "idx"))))
    out = joined.groupBy(id_col).agg(ordered.alias("x")).select(id_col, F.col("x.idx").alias("ids"))
    if pad_to_length is not None:
        padded = F.concat("ids", F.array_repeat(F.lit(0), pad_to_length))
        out = out.withColumn("ids", F.slice(padded, 1, pad_to_length))
    return out


def decode(ids: DataFrame, id_col: str, vocab: DataFrame, separator: str = " ") -> DataFrame:
    """(id, text): the terms of arrays of vocabulary numbers, joined."""
    placed = ids.select(id_col, F.posexplode_outer("ids").alias("pos", "idx")).join(sized(vocab.select("idx", "term")), "idx", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.isnotnull("term"), F.struct("pos", "term"))))
    return placed.groupBy(id_col).agg(ordered.alias("x")).select(id_col, F.array_join("x.term", separator).alias("text"))


def by_rows(docs: DataFrame, id_col: str, max_features: int | None) -> bool:
    """Whether each text can be counted where it lies: the vocabulary has a bound and no id has two rows."""
    return max_features is not None and max_features <= LOOKED_UP and docs.groupBy(id_col).count().where("count > 1").isEmpty()


def found_terms(docs: DataFrame, id_col: str, tokens: Column, best: list[str], idf: list[float] | None = None) -> DataFrame:
    """(id, term, n) of the terms in best, looked up in each row's own words: nothing is shuffled. With idf n is not the
    count but count / words of the row * idf, in rows of length 1."""
    rows = docs.select(id_col, tokens.alias("t"))
    held, most, whole = docs.sparkSession.sparkContext.broadcast((best, idf)), WORDS, idf is None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scale = pa.array(held.value[0], pa.string()), held.value[1]
        for batch in batches:
            sizes = np.nan_to_num(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            block = (np.cumsum(sizes) - sizes) // most
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                at = pc.index_in(part.column(1).flatten(), value_set=known)
                code, row = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(b - a), sizes[a:b])
                both, n = np.unique((row * len(known) + code)[code >= 0], return_counts=True)
                row, code = np.divmod(both, max(1, len(known)))
                if scale is not None:
                    n = n / sizes[a:b][row] * np.array(scale, float)[code]
                    length = np.sqrt(np.bincount(row, n * n, minlength=b - a))
                    n = n / np.where(length == 0, 1.0, length)[row]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), known.take(pa.array(code)), pa.array(n, pa.int64() if scale is None else pa.float64())], names=[id_col, "term", "n"])

    return rows.mapInArrow(kernel, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, term string, n {'long' if whole else 'double'}")


def count_vectorize(docs: DataFrame, id_col: str, text: str, max_features: int | None = 5000, lowercase: bool = True) -> DataFrame:
    """(id, term, n) for the terms of largest total count."""
    if by_rows(docs, id_col, max_features):
        weights = terms(docs, id_col, text, lowercase).groupBy("term").agg(F.count("*").alias("w"))
        best = [r.term for r in top_terms(weights, "w", max_features).collect()]
        return found_terms(docs, id_col, term_list(text, lowercase), best)
    counts = cut(term_counts(docs, id_col, text, lowercase=lowercase))  # read twice: tokens are found once
    best = top_terms(counts.groupBy("term").agg(F.sum("n").alias("w")), "w", max_features).select("term")
    return counts.join(sized(best), "term").select(id_col, "term", "n")


def document_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df) where no id has two rows."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def binary_vectorize(docs: DataFrame, id_col: str, text: str, max_features: int | None = 5000, lowercase: bool = True) -> DataFrame:
    """(id, term, value 1) for the terms in most documents."""
    if by_rows(docs, id_col, max_features):
        tokens = term_list(text, lowercase)
        best = [r.term for r in top_terms(document_frequencies(docs, tokens), "df", max_features).collect()]
        return found_terms(docs, id_col, tokens, best).select(id_col, "term", F.lit(1).alias("value"))
    found = cut(term_counts(docs, id_col, text, lowercase=lowercase).select(id_col, "term"))
    best = top_terms(found.groupBy("term").agg(F.count("*").alias("w")), "w", max_features).select("term")
    return found.join(sized(best), "term").select(id_col, "term", F.lit(1).alias("value"))


def tfidf(docs: DataFrame, id_col: str, text: str, max_features: int | None = 5000, min_df: int = 1, max_df: float = 1.0, lowercase: bool = True, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(id, term, weight): count / n-grams of the text * ln(documents / documents with the term), rows of length 1.

    The vocabulary is the terms in most documents among those in min_df documents or more and a share of max_df or less.
    """
    n_docs = docs.count()
    used = lambda df: df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    idf = F.ln(F.lit(float(n_docs)) / F.col("df"))
    if by_rows(docs, id_col, max_features):
        tokens = term_list(text, lowercase, ngram_range)
        best = top_terms(used(document_frequencies(docs, tokens)), "df", max_features).select("term", idf.alias("idf")).collect()
        return found_terms(docs, id_col, tokens, [r.term for r in best], [r.idf for r in best]).withColumnRenamed("n", "weight")
    counts = cut(term_counts(docs, id_col, text, lowercase=lowercase, ngram_range=ngram_range))  # read three times
    best = sized(top_terms(used(counts.groupBy("term").agg(F.count("*").alias("df"))), "df", max_features))
    sizes = counts.groupBy(id_col).agg(F.sum("n").alias("size"))
    weight = F.col("n") / F.col("size") * idf
    raw = counts.join(best, "term").join(sizes, id_col).select(id_col, "term", weight.alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / F.when(length == 0, F.lit(1.0)).otherwise(length)).alias("weight"))


def cooccurrence(docs: DataFrame, id_col: str, tokens: Column, window: int = 5) -> DataFrame:
    """(a, b, n): how often b stands within window places of a, by shifts of the token array: nothing is joined."""
    pairs = []
    for k in range(1, window + 1):
        pairs.append(F.when(F.size("t") > k, F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - k).alias("a"), F.slice("t", F.lit(k + 1), F.size("t") - k).alias("b"))))
    empty = F.array().cast("array<struct<a:string,b:string>>")
    rows = docs.select(tokens.alias("t")).select(F.explode(F.concat(*[F.coalesce(p.cast("array<struct<a:string,b:string>>"), empty) for p in pairs])).alias("p"))
    half = rows.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def char_ngrams(word: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of #word#."""
    marked = F.concat(F.lit("#"), word, F.lit("#"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def subword_vectors(words: DataFrame, word: str, vectors: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """(word, v): mean of the vectors (gram, v) of a word's known n-grams; no row for a word without any."""
    grams = words.select(word, F.explode(char_ngrams(F.col(word), low, high)).alias("gram")).join(vectors, "gram")
    wide = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if wide > MEANS:
        means = grams.select(word, F.posexplode("v").alias("i", "x")).groupBy(word, "i").agg(F.avg("x").alias("x"))
        return means.groupBy(word).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(word, F.col("p.x").alias("v"))
    means = [F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(wide)]  # a row for each gram, not for each of its numbers
    found = grams.groupBy(word).agg(F.max(F.size("v")).alias("__n"), *means).where("__n > 0")
    return found.select(word, F.slice(F.array(*[f"m{i}" for i in range(wide)]), F.lit(1), F.col("__n")).alias("v"))


def word2vec(docs: DataFrame, tokens: Column, size: int = 100, window: int = 5, min_count: int = 5, iterations: int = 1, step: float = 0.025, seed: int = 42) -> DataFrame:
    """(word, vector) by skip-gram: Spark's own trainer, whose vectors differ from a sequential one's but not their use."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, stepSize=step, seed=seed, inputCol="t", outputCol="v", numPartitions=max(1, docs.sparkSession.sparkContext.defaultParallelism)).fit(docs.select(tokens.alias("t")))
    return model.getVectors()
