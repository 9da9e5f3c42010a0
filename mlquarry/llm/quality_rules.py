"""Quality rules: base measures of every text, and how much more its n-grams look like trusted text than like the corpus.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets are counted, one from
the trusted documents and one from all of them; both get PRIOR trusted n-grams more in each bucket, so a bucket weighs in
as there is evidence for it. A text's score is the mean over its n-grams of ln(trusted share / corpus share), and the
text is kept if the score reaches THRESHOLD, whatever the other texts score.

Counting sends one row a bucket and task; the table of ratios has BUCKETS numbers and is broadcast.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, empty_text

BUCKETS = 1 << 18
PRIOR = 10
THRESHOLD = -0.1
MIN_WORDS = 50
#: Words that a worker remembers.
MEMORY = 600_000
#: Up to so many trusted ids (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


class Words(dict):
    """Words as bytes to small ids, and the hash of each id: the first 32 bits of its MD5."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big"))
        return found

    def forget(self, most: int = MEMORY) -> None:
        if len(self) > most:
            self.clear()
            self.hashes = array("q")


_words = Words()


class Texts:
    """Several texts as one array of word ids (ids) with the number of the text of each (doc)."""

    def __init__(self, texts: list[str]):
        _words.forget()
        split = [t.encode().split() for t in texts]
        self.texts = texts
        self.n_words = np.fromiter(map(len, split), np.int64, len(split))
        self.ids = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), np.int64, int(self.n_words.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every word and of every pair of neighbours, and the text of each."""
        h = np.array(_words.hashes, np.int64)[self.ids]
        same = self.doc[1:] == self.doc[:-1]
        pairs = (h[:-1] * 31 + h[1:])[same]
        return np.concatenate((h, pairs)) & (BUCKETS - 1), np.concatenate((self.doc, self.doc[1:][same]))

    def repeat_words(self) -> np.ndarray:
        """For each text the words in windows of three that it has twice or more."""
        at = np.flatnonzero(self.doc[2:] == self.doc[:-2])
        a, b, c, doc = self.ids[at], self.ids[at + 1], self.ids[at + 2], self.doc[at]
        if len(_words) < 1 << 21:
            code = a << 42 | b << 21 | c
        else:  # one text with millions of different words
            code = np.unique(a << 31 | b, return_inverse=True)[1] << 31 | c
        order = np.lexsort((code, doc))
        twin = (code[order][1:] == code[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        found = at[order[np.concatenate((twin, [False])) | np.concatenate(([False], twin))]] if at.size else at
        covered = np.zeros(self.ids.size, bool)
        for k in range(3):
            covered[found + k] = True
        return np.bincount(self.doc[covered], minlength=len(self.texts))


def base_measures(texts: list[str]) -> tuple[Texts, dict[str, np.ndarray]]:
    own = Texts(texts)
    lines = [[x for x in t.split("\n") if x.strip(SPACE)] for t in texts]
    found = {
        "n_words": own.n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": own.repeat_words(),
    }
    found["base_failed"] = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    return own, found


def scores(own: Texts, ratios: np.ndarray) -> np.ndarray:
    """The mean log ratio of each text's n-grams to six places; 0 for a text without words."""
    bucket, doc = own.buckets()
    n = np.bincount(doc, minlength=len(own.texts))
    return np.round(np.bincount(doc, weights=ratios[bucket], minlength=len(own.texts)) / np.maximum(n, 1), 6)


def forget_words() -> None:
    """Frees what this worker remembers; the stages that come after need the memory."""
    _words.forget(0)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """__id of the documents that labels mark as good."""
    return labels.where("quality = 1").select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """ln of trusted to corpus share for every bucket. trusted: a column __id of doc_ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in chunks(batches):
            own = Texts(empty_text(batch.column(0).to_pylist()))
            bucket, doc = own.buckets()
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[doc]
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[good], minlength=BUCKETS)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[0][there]), pa.array(total[1][there])], names=["b", "n", "t"])

    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(trusted) if few else trusted
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id") == F.col("__id"), "left")
    counted = rows.select("text", F.isnotnull("__id").alias("good")).mapInArrow(kernel, "b long, n long, t long")
    table = counted.groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()  # at most BUCKETS rows
    n, t = np.zeros((2, BUCKETS))
    where = table["b"].to_numpy()
    n[where], t[where] = table["n"].to_numpy(), table["t"].to_numpy()
    share = t.sum() / max(1, n.sum())
    return np.log((t + PRIOR) / (n * share + PRIOR))


MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "score": "double", "kept": "boolean"}


def judged(texts: list[str], ratios: np.ndarray) -> dict[str, np.ndarray]:
    own, found = base_measures(texts)
    found["score"] = scores(own, ratios)
    found["kept"] = ~found["base_failed"] & (found["score"] >= THRESHOLD)
    return found


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of every row.

    labels has doc_id and quality; ids that it repeats count once, ids that it lacks or has as null are not trusted, and
    without any trusted document every score is 0. Null texts count as empty and fail the base rules. Repeated rows stay
    repeated; columns other than doc_id and text are not looked at; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted_ids(labels)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = judged(empty_text(batch.column(1).to_pylist()), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[k]) for k in MEASURES]], names=["doc_id", *MEASURES])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in MEASURES.items()))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that assess() keeps."""
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted_ids(labels)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = pc.cast(batch.column(batch.schema.get_field_index("text")), pa.string()).to_pylist()
            yield batch.filter(pa.array(judged(empty_text(texts), held.value)["kept"]))
        forget_words()

    return docs.mapInArrow(kernel, docs.schema)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM l),
h AS (SELECT doc_id, i, word, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w),
n AS (SELECT *, lead(h) OVER o AS h2, lead(word) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, h % {BUCKETS} AS b FROM n UNION ALL SELECT doc_id, (h * 31 + h2) % {BUCKETS} FROM n WHERE h2 IS NOT NULL),
t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (SELECT b, count(*) AS n, count(*) FILTER (t.doc_id IS NOT NULL) AS t FROM g LEFT JOIN t USING (doc_id) GROUP BY b),
r AS (SELECT b, ln((t + {PRIOR}) / (n * (SELECT sum(t) / sum(n) FROM c) + {PRIOR})) AS r FROM c),
s AS (SELECT doc_id, round(avg(r), 6) AS score FROM g JOIN r USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, i FROM n WHERE word3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, word2, word3) > 1),
p AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM x) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score, 0.0) AS score
      FROM l LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND score >= {THRESHOLD} AS kept FROM f
"""
