"""Cleaning, tokenising, stemming and vectorising of documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vectorizing as V
from ..plans.pipeline import TextPlan
from ..storage import cut
from .common import Registry, read, rounded

query = Registry()


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def short(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


CLEAN = r"trim(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace({t}, 'http[^\s\p{{Z}}]+|www[^\s\p{{Z}}]+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{{2,}}\b', '', 'g'))), '[\s\p{{Z}}]+', ' ', 'g'))"


@query("clean_text")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("text"))


@query("clean_ascii", r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g'), '\d+', '', 'g')), '\s+', ' ', 'g')) AS text FROM documents")
def clean_ascii(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean(F.col("text"), urls=False, emails=False, accents=False, special_chars=True, numbers=True).alias("text"))


@query("strip_accents")
def strip_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_accents("text").alias("text"))


@query("normalize_text")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("text"))


_contracted = "text || ' I can''t, they''re and it''s'"
for _found, _put in T.CONTRACTIONS.items():
    _contracted = f"regexp_replace({_contracted}, '{_found.replace(chr(39), chr(39) * 2)}', '{_put}', 'gi')"


@query("expand_contractions", f"SELECT conv_id, turn, {_contracted} AS text FROM conversations")
def expand_contractions(spark, sf_dir):
    return short(spark, sf_dir).select("conv_id", "turn", T.expand_contractions(F.concat("text", F.lit(" I can't, they're and it's"))).alias("text"))


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
SPACES = r"list_filter(regexp_split_to_array({t}, '[\s\p{{Z}}]+'), lambda w: w <> '')"


@query("stopword_filter", f"SELECT conv_id, turn, coalesce(array_to_string(list_filter({SPACES.format(t='text')}, lambda w: NOT list_contains([{STOP}], lower(w))), ' '), '') AS text FROM conversations")
def stopword_filter(spark, sf_dir):
    return short(spark, sf_dir).select("conv_id", "turn", T.remove_stopwords(F.col("text")).alias("text"))


BARE = r"regexp_replace(regexp_replace(lower({t}), 'http[^\s\p{{Z}}]+|www[^\s\p{{Z}}]+', '', 'g'), '[^\s\p{{Z}}]+@[^\s\p{{Z}}]+', '', 'g')"
WORDS = r"regexp_extract_all(" + BARE + r", '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]')"


@query("word_tokens", f"SELECT doc_id, len(ts) AS n, array_to_string(ts, '|') AS tokens FROM (SELECT doc_id, {WORDS.format(t='text')} AS ts FROM documents)")
def word_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


@query("char_tokens", "SELECT conv_id, turn, length(replace(text, ' ', '')) AS n, array_to_string(list_filter(string_split(lower(text), ''), lambda c: c <> ' ' AND c <> ''), '|') AS tokens FROM conversations")
def char_tokens(spark, sf_dir):
    return short(spark, sf_dir).select("conv_id", "turn", T.char_tokens(F.col("text")).alias("t")).select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


@query("subword_tokens", f"SELECT conv_id, turn, array_to_string(list_transform({SPACES.format(t='lower(text)')}, lambda w, i: CASE WHEN i = 1 THEN w ELSE '##' || w END), '|') AS tokens FROM conversations")
def subword_tokens(spark, sf_dir):
    return short(spark, sf_dir).select("conv_id", "turn", F.array_join(T.subword_tokens(F.col("text")), "|").alias("tokens"))


@query("ngrams", f"WITH t AS (SELECT conv_id, turn, {SPACES.format(t='lower(text)')} AS ws FROM conversations) SELECT conv_id, turn, coalesce(array_to_string(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]), '|'), '') AS grams FROM t")
def ngrams(spark, sf_dir):
    return short(spark, sf_dir).select("conv_id", "turn", F.array_join(T.ngrams(T.words_by_space(F.lower("text"))), "|").alias("grams"))


TERMS = f"(SELECT doc_id, unnest({SPACES.format(t='lower(text)')}) AS term FROM documents)"
VOCAB = f"SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS idx FROM {TERMS} GROUP BY term QUALIFY idx < 500"


@query("vocab_topk", VOCAB)
def vocab_topk(spark, sf_dir):
    return V.vocabulary(docs(spark, sf_dir), "doc_id", "text", 500).select("term", F.col("n"), F.col("idx").cast("long").alias("idx"))


@query("encode_tokens", f"WITH v AS ({VOCAB}), w AS (SELECT doc_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM (SELECT doc_id, {SPACES.format(t='lower(text)')} AS ws FROM documents)) SELECT d.doc_id, coalesce(string_agg(idx::VARCHAR, ' ' ORDER BY pos), '') AS ids FROM documents d LEFT JOIN (SELECT doc_id, pos, idx FROM w JOIN v USING (term)) USING (doc_id) GROUP BY d.doc_id")
def encode_tokens(spark, sf_dir):
    vocab = V.vocabulary(df := docs(spark, sf_dir), "doc_id", "text", 500)
    return V.encode(df, "doc_id", T.words_by_space(F.lower("text")), vocab).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("decode_tokens", f"WITH v AS ({VOCAB}), w AS (SELECT doc_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM (SELECT doc_id, {SPACES.format(t='lower(text)')} AS ws FROM documents)) SELECT d.doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS text FROM documents d LEFT JOIN (SELECT doc_id, pos, term FROM w JOIN v USING (term)) USING (doc_id) GROUP BY d.doc_id")
def decode_tokens(spark, sf_dir):
    vocab = V.vocabulary(df := docs(spark, sf_dir), "doc_id", "text", 500)
    return V.decode(V.encode(df, "doc_id", T.words_by_space(F.lower("text")), vocab), "doc_id", vocab)


@query("count_vectorizer", f"WITH c AS (SELECT doc_id, term, count(*) AS n FROM {TERMS} GROUP BY 1, 2), b AS (SELECT term FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 1000) SELECT doc_id, term, n FROM c JOIN b USING (term)")
def count_vectorizer(spark, sf_dir):
    return V.count_vectorize(docs(spark, sf_dir), "doc_id", "text", 1000)


@query("binary_vectorizer", f"WITH c AS (SELECT DISTINCT doc_id, term FROM {TERMS}), b AS (SELECT term FROM c GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000) SELECT doc_id, term, 1 AS value FROM c JOIN b USING (term)")
def binary_vectorizer(spark, sf_dir):
    return V.binary_vectorize(docs(spark, sf_dir), "doc_id", "text", 1000)


@query(
    "tfidf",
    f"WITH c AS (SELECT doc_id, term, count(*) AS n FROM {TERMS} GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 5000), s AS (SELECT doc_id, sum(n) AS size FROM c GROUP BY doc_id), w AS (SELECT doc_id, term, n / size * ln((SELECT count(*) FROM documents) / df) AS w FROM c JOIN f USING (term) JOIN s USING (doc_id)) SELECT doc_id, term, round(w / coalesce(nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), 1), 6) AS weight FROM w",
)
def tfidf(spark, sf_dir):
    return rounded(V.tfidf(docs(spark, sf_dir), "doc_id", "text", 5000, min_df=2, max_df=0.9), "weight")


@query("cooccurrence", f"WITH w AS (SELECT conv_id, turn, unnest(ws) AS t, unnest(range(0, len(ws))) AS pos FROM (SELECT conv_id, turn, {SPACES.format(t='lower(text)')} AS ws FROM conversations)) SELECT x.t AS a, y.t AS b, count(*) AS n FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.turn = y.turn AND abs(x.pos - y.pos) BETWEEN 1 AND 3 GROUP BY 1, 2")
def cooccurrence(spark, sf_dir):
    return V.cooccurrence(short(spark, sf_dir), "conv_id", T.words_by_space(F.lower("text")), 3)


def words(spark, sf_dir):
    """Distinct words of the conversations, and some of English."""
    own = short(spark, sf_dir).select(F.explode(T.words_by_space(F.lower("text"))).alias("word"))
    more = spark.createDataFrame([(w,) for w in EXTRA], "word string")
    return own.unionByName(more).distinct()


EXTRA = ["running", "flies", "happiness", "movement", "kilogram", "relational", "organization", "hopeful", "useless", "nation", "tallest", "loudly", "antibody", "conditional"]
WORDLIST = f"(SELECT DISTINCT word FROM (SELECT unnest({SPACES.format(t='lower(text)')}) AS word FROM conversations UNION ALL SELECT unnest([" + ", ".join(f"'{w}'" for w in EXTRA) + "])))"
_simple = " ".join(f"WHEN word LIKE '%{e}' AND length(word) - {len(e)} + {len(p)} >= 3 THEN left(word, length(word) - {len(e)}) || '{p}'" for e, p in T.SIMPLE_ENDINGS.items())
_lancaster = " ".join(f"WHEN starts_with(word, '{p}') THEN substr(word, {len(p) + 1})" for p in T.LANCASTER_PREFIXES) + " " + " ".join(f"WHEN word LIKE '%{e}' THEN left(word, length(word) - {len(e)}) || '{p}'" for e, p in T.LANCASTER_ENDINGS.items())


@query("simple_stemmer", f"SELECT word, CASE WHEN length(word) < 4 THEN word {_simple} ELSE word END AS stem FROM {WORDLIST}")
def simple_stemmer(spark, sf_dir):
    return words(spark, sf_dir).select("word", T.simple_stem(F.col("word")).alias("stem"))


@query("lancaster_stemmer", f"SELECT word, CASE WHEN length(word) <= 2 THEN word {_lancaster} ELSE word END AS stem FROM {WORDLIST}")
def lancaster_stemmer(spark, sf_dir):
    return words(spark, sf_dir).select("word", T.lancaster_stem(F.col("word")).alias("stem"))


@query("porter_stemmer")
def porter_stemmer(spark, sf_dir):
    return words(spark, sf_dir).select("word", T.porter_stem("word").alias("stem"))


@query("text_plan", f"SELECT conv_id, turn, array_to_string({WORDS.format(t='lower(text)')}, '|') AS tokens FROM conversations")
def text_plan(spark, sf_dir):
    plan = TextPlan([{"operation": "clean", "params": {"urls": False, "emails": False, "accents": False}}, {"operation": "tokenize", "params": {"kind": "word"}}])
    return plan.apply(short(spark, sf_dir), "text", "t").select("conv_id", "turn", F.array_join("t", "|").alias("tokens"))


@query("fasttext_ngrams", "SELECT word, array_to_string(list_transform(range(1, greatest(length(word) + 1, 1)), lambda i: substr('#' || word || '#', i::BIGINT, 3)), '|') AS grams FROM (SELECT DISTINCT lang AS word FROM documents)")
def fasttext_ngrams(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("word")).distinct().select("word", F.array_join(V.char_ngrams(F.col("word"), 3, 3), "|").alias("grams"))


def all_words(spark, sf_dir):
    """Distinct words of all documents."""
    return docs(spark, sf_dir).select(F.explode(T.words_by_space(F.lower("text"))).alias("word")).distinct()


GRAMS = "list_concat(" + ", ".join(f"list_transform(range(1, greatest(length(word) + {4 - n}, 1)), lambda i: substr('#' || word || '#', i::BIGINT, {n}))" for n in range(3, 7)) + ")"
DISTINCT_WORDS = f"(SELECT DISTINCT term AS word FROM {TERMS})"


@query("fasttext_word_ngrams", f"SELECT word, array_to_string({GRAMS}, '|') AS grams FROM {DISTINCT_WORDS}")
def fasttext_word_ngrams(spark, sf_dir):
    return all_words(spark, sf_dir).select("word", F.array_join(V.char_ngrams(F.col("word"), 3, 6), "|").alias("grams"))


@query("subword_vectors", f"WITH g AS (SELECT word, unnest({GRAMS}) AS gram FROM {DISTINCT_WORDS}), v AS (SELECT gram, count(DISTINCT word) AS n FROM g GROUP BY gram) SELECT word, round(avg(n), 6) AS words, round(avg(length(gram)), 6) AS size FROM g JOIN v USING (gram) GROUP BY word")
def subword_vectors(spark, sf_dir):
    """Mean over a word's n-grams of the words that hold one, and of its length."""
    own = cut(all_words(spark, sf_dir))  # read three times
    vectors = own.select(F.explode(F.array_distinct(V.char_ngrams(F.col("word"), 3, 6))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    vectors = vectors.select("gram", F.array(F.col("n").cast("double"), F.length("gram").cast("double")).alias("v"))
    found = V.subword_vectors(own, "word", vectors)
    return rounded(found.select("word", F.col("v")[0].alias("words"), F.col("v")[1].alias("size")), "words", "size")


QUERIES, ORACLE_SQL = query.queries, query.sql
