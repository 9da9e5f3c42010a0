"""Cleaning, normalising, tokenising and stemming of text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the cleaning rules: contractions and what they stand for, in the order of replacement, and stopwords.
CONTRACTIONS = {
    "ain't": "am not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have", "'cause": "because",
    "could've": "could have", "couldn't": "could not", "didn't": "did not", "doesn't": "does not", "don't": "do not",
    "hadn't": "had not", "hasn't": "has not", "haven't": "have not", "he'd": "he would", "he'll": "he will",
    "he's": "he is", "how'd": "how did", "how'll": "how will", "how's": "how is", "i'd": "i would", "i'll": "i will",
    "i'm": "i am", "i've": "i have", "isn't": "is not", "it'd": "it would", "it'll": "it will", "it's": "it is",
    "let's": "let us", "shouldn't": "should not", "that's": "that is", "there's": "there is", "they'd": "they would",
    "they'll": "they will", "they're": "they are", "they've": "they have", "wasn't": "was not", "we'd": "we would",
    "we'll": "we will", "we're": "we are", "we've": "we have", "weren't": "were not", "what's": "what is",
    "won't": "will not", "wouldn't": "would not", "you'd": "you would", "you'll": "you will", "you're": "you are",
    "you've": "you have",
}
STOPWORDS = tuple(
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot "
    "could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd "
    "he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself just k let's m me "
    "might more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll "
    "she's should shouldn't so some such t than that that's the their theirs them themselves then there there's these they they'd they'll they're "
    "they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's "
    "which while who who's whom why why's with won't would wouldn't y you you'd you'll you're you've your yours yourself yourselves".split()
)

URLS = r"(?U)http\S+|www\S+"
EMAILS = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"
ADDRESSES = r"(?U)\S+@\S+"


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Letters without their combining marks, composed again."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_unicode(text: Column) -> Column:
    """The compatible composed form (NFKC)."""
    return _compatible(text)


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URLS, "")


def remove_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAILS, "")


def expand_contractions(text: Column) -> Column:
    for found, put in CONTRACTIONS.items():
        text = F.regexp_replace(text, f"(?i){found}", put)
    return text


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def remove_stopwords(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_join(F.filter(words_by_space(text), lambda w: ~F.array_contains(stop, F.lower(w))), " ")


def clean(
    text: Column,
    urls: bool = True,
    emails: bool = True,
    contractions: bool = False,
    accents: bool = True,
    special_chars: bool = False,
    numbers: bool = False,
    lowercase: bool = True,
    whitespace: bool = True,
    stopwords: Sequence[str] | None = None,
) -> Column:
    """The chosen steps in this order; the result has no blanks around it."""
    if urls:
        text = remove_urls(text)
    if emails:
        text = remove_emails(text)
    if contractions:
        text = expand_contractions(text)
    if accents:
        text = strip_accents(text)
    if special_chars:
        text = F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")
    if numbers:
        text = F.regexp_replace(text, r"(?U)\d+", "")
    if lowercase:
        text = F.lower(text)
    if whitespace:
        text = collapse_whitespace(text)
    if stopwords:
        text = remove_stopwords(text, stopwords)
    return F.trim(text)


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, "‘’“”", "''\"\"")


def normalize_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, "[-–—]", "-")


def remove_control_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t\r]]", "")


def normalize(text: Column, lowercase: bool = True, accents: bool = True) -> Column:
    """White space, quotes, hyphens, control characters, accents, case."""
    text = F.trim(collapse_whitespace(text))
    text = remove_control_characters(normalize_hyphens(normalize_quotes(text)))
    text = strip_accents(text) if accents else text
    return F.lower(text) if lowercase else text


def words_by_space(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_tokens(text: Column, lowercase: bool = True) -> Column:
    """Words and single signs, without URLs and e-mail addresses."""
    text = F.regexp_replace(F.regexp_replace(text, URLS, ""), ADDRESSES, "")
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(r"(?U)\b\w+\b|[^\w\s]"), F.lit(0))


def char_tokens(text: Column, lowercase: bool = True) -> Column:
    """Characters but blanks."""
    return F.filter(F.split(F.lower(text) if lowercase else text, ""), lambda c: (c != "") & (c != " "))


def subword_tokens(text: Column, lowercase: bool = True) -> Column:
    """Pieces between white space, each but the first marked with ##."""
    return F.transform(words_by_space(F.lower(text) if lowercase else text), lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit("##"), w)))


def tokenize(text: Column, kind: str = "word", lowercase: bool = True) -> Column:
    kinds = {"word": word_tokens, "character": char_tokens, "subword": subword_tokens}
    if kind not in kinds:
        raise ValueError(f"unknown tokenization {kind!r}")
    return kinds[kind](text, lowercase)


def ngrams(tokens: Column, n: int = 2, separator: str = " ") -> Column:
    """n tokens in a row, joined; none for fewer tokens."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), separator))).otherwise(F.array().cast("array<string>"))


# Fixed values of the stemmers: endings and their replacements in the order in which they are tried, and prefixes.
SIMPLE_ENDINGS = {"ies": "i", "es": "e", "ed": "", "ing": "", "ings": "", "ly": "", "ness": "", "ment": "", "ful": "", "less": "", "able": "", "ible": "", "tion": "", "sion": "", "er": "", "est": ""}
LANCASTER_PREFIXES = ("kilo", "mega", "giga", "anti", "multi", "pseudo")
LANCASTER_ENDINGS = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate"}
PORTER_PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
PORTER_LONG = LANCASTER_ENDINGS | {"ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
PORTER_SHORT = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_FINAL = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou")


def simple_stem(word: Column, least: int = 3) -> Column:
    """The word with its first ending replaced whose result has least letters; words of fewer than four letters stay."""
    word = F.lower(word)
    out = F.when(F.length(word) < 4, word)
    for e, put in SIMPLE_ENDINGS.items():
        stem = F.concat(F.substring(word, F.lit(1), F.length(word) - len(e)), F.lit(put))
        out = out.when(F.endswith(word, F.lit(e)) & (F.length(stem) >= least), stem)
    return out.otherwise(word)


def lancaster_stem(word: Column) -> Column:
    """One prefix cut, or else one ending rewritten; words of one or two letters stay."""
    word = F.lower(word)
    out = F.when(F.length(word) <= 2, word)
    for p in LANCASTER_PREFIXES:
        out = out.when(F.startswith(word, F.lit(p)), F.substring(word, F.lit(len(p) + 1), F.length(word)))
    for e, put in LANCASTER_ENDINGS.items():
        out = out.when(F.endswith(word, F.lit(e)), F.concat(F.substring(word, F.lit(1), F.length(word) - len(e)), F.lit(put)))
    return out.otherwise(word)


class _Shape:
    """What Porter's rules ask of a stem. Only a, e, i, o and u are vowels; the measure counts vowels after a consonant."""

    def __init__(self, stem: str):
        self.kinds = "".join("v" if c in "aeiou" else "c" for c in stem)
        self.measure = self.kinds.count("cv")
        self.vowel = "v" in self.kinds
        self.closed = self.kinds.endswith("cvc") and stem[-1] not in "wxy"


def _rewritten(word: str, endings: dict[str, str] | tuple, least: int) -> str:
    """The first ending replaced whose stem has a measure of least."""
    for e in endings:
        if word.endswith(e) and _Shape(word[: -len(e)]).measure >= least:
            return word[: -len(e)] + (endings[e] if isinstance(endings, dict) else "")
    return word


def porter(word: str) -> str:
    """A Porter stemmer with these rules: plurals, past forms, final y, long and short endings, final e and ll."""
    word = word.lower()
    if len(word) <= 2:
        return word
    plural = next((e for e in PORTER_PLURALS if word.endswith(e)), None)
    if plural:
        word = word[: -len(plural)] + PORTER_PLURALS[plural]
    past = next((e for e in ("eed", "ed", "ing") if word.endswith(e)), None)
    if past == "eed":
        word = word[:-1] if _Shape(word[:-3]).measure > 0 else word
    elif past and _Shape(word[: -len(past)]).vowel:
        word = word[: -len(past)]
        shape = _Shape(word)
        if word.endswith(("at", "bl", "iz")) or not (word[-1:] == word[-2:-1] and word[-1] not in "lsz") and shape.measure == 1 and shape.closed:
            word += "e"
        elif len(word) >= 2 and word[-1] == word[-2] and word[-1] not in "lsz":
            word = word[:-1]
    if len(word) > 1 and word[-1] == "y" and word[-2] not in "aeiou":
        word = word[:-1] + "i"
    word = _rewritten(_rewritten(word, PORTER_LONG, 1), PORTER_SHORT, 1)
    shorter = _rewritten(word, PORTER_FINAL, 2)
    if shorter == word and word.endswith("ion") and word[-4:-3] in ("s", "t") and _Shape(word[:-3]).measure > 1:
        shorter = word[:-3]
    word = shorter
    if word.endswith("e"):
        shape = _Shape(word[:-1])
        if shape.measure > 1 or shape.measure == 1 and not shape.closed:
            return word[:-1]
    return word[:-1] if word.endswith("ll") and _Shape(word).measure > 1 else word


@F.pandas_udf(T.StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Porter stems; each distinct word of a batch is stemmed once."""
    stems = {w: porter(w) for w in words.dropna().unique()}
    return words.map(stems)
