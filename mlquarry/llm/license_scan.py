"""Finding documents that are a known licence, whatever their case, punctuation, copyright lines and spelling.

The whole text is brought to a canonical form and only its SHA-256 is compared with the digests of known licences, so
a scan moves 32 bytes a document and no text. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import SPELLINGS, STATEMENTS, TEXTS

#: The foundation's own statement is part of its licences, whatever line it stands on.
FOUNDATION = r"copyright\s+(\(c\)|©)\s+[0-9,\s]+\s+free\s+software\s+foundation"
#: A line that states a copyright, with comment signs before it: a year or a copyright sign follows the word, so lines of
#: prose that happen to begin with it ("copyright notice and this permission notice ...", "(c) You must ...") are none.
COPYRIGHT = r"(^|\n)[ \t/*#;%.-]*((copyright|\(c\)|©)([ \t:,]|copyright|\(c\)|©)*[12][0-9][0-9][0-9]|copyright[ \t]*(\(c\)|©))[^\n]*"
NOT_WORDS = r"[^\p{L}\p{N}]+"
#: The known licences are broadcast up to this number, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words apart by one space, one spelling. Where lines are broken does not count."""
    lower = F.regexp_replace(F.lower(text), FOUNDATION, "free software foundation")
    plain = F.regexp_replace(F.regexp_replace(lower, COPYRIGHT, "\n"), NOT_WORDS, " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for found, put in (*SPELLINGS.items(), *((x, "") for x in STATEMENTS)):
        plain = F.replace(plain, F.lit(f" {found} "), F.lit(f" {put} " if put else " "))
    return F.trim(plain)


def digests(texts: DataFrame, text: str = "text") -> Column:
    return F.sha2(canonical(texts[text]), 256)


def scan(docs: DataFrame, known: Mapping[str, str] = TEXTS) -> DataFrame:
    """doc_id, digest and license_id (null if the text is no known licence) of every row.

    Null texts have neither; empty ones have the digest of nothing. Of known texts with one digest the first name in
    alphabetical order is given. Repeated rows stay repeated; columns other than doc_id and text are not looked at; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known.items()), "license_id string, text string")
    names = table.select(digests(table).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", digests(docs).alias("digest"))
    return rows.join(F.broadcast(names) if len(known) <= BROADCAST_ROWS else names, "digest", "left").select("doc_id", "digest", "license_id")


def _sql(column: str) -> str:
    plain = f"' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower({column}), '{FOUNDATION}', 'free software foundation', 'g'), '{COPYRIGHT}', chr(10), 'g'), '{NOT_WORDS}', ' ', 'g')) || ' '"
    for found, put in (*SPELLINGS.items(), *((x, "") for x in STATEMENTS)):
        plain = f"replace({plain}, ' {found} ', '{f' {put} ' if put else ' '}')"
    return f"sha256(trim({plain}))"


def oracle(known: Mapping[str, str] = TEXTS) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known.items())
    return f"""
WITH k AS (SELECT {_sql('t')} AS digest, min(id) AS license_id FROM (VALUES {rows}) AS v(id, t) GROUP BY 1),
d AS (SELECT doc_id, {_sql('text')} AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN k USING (digest)
"""
