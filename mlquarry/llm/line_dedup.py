"""Removing passages that repeat across documents, by windows of three lines.

Every three consecutive lines are a window. Windows are hashed inside the row, so only 16 bytes of digest and a place
are shuffled; of equal windows the first in order of (doc_id, text digest, line) stays and all later ones are covered.
Overlapping covered windows merge by themselves: what is kept are the gaps between them. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, width: int = WINDOW, short: bool = False) -> DataFrame:
    """One row per window that has a line with a word: place (late, id, th, line) and digest (h1, h2).

    Blanks around a line do not count. late is true where doc_id is null, so that such rows come last. short: a text of
    fewer lines than a window is one window of all its lines, hashed with their number.
    """
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r")))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), trimmed.alias("lines"))
    rows = rows.where(F.isnotnull("lines") if short else F.size("lines") >= width)

    def digest(i: Column) -> Column:
        parts = [F.get("lines", i + k) for k in range(width)]
        blank = F.length(F.concat_ws("", *parts) if short else F.concat(*parts)) == 0
        if short:
            parts.append(F.least(F.size("lines"), F.lit(width)))
        return F.when(~blank, F.struct(i.alias("line"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2")))

    last = F.size("lines") - width
    places = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)) if short else last), digest)
    found = rows.select("id", "th", F.explode(places).alias("w")).where("w is not null")
    return found.select(F.struct(F.isnull("id").alias("late"), "id", "th", F.col("w.line").alias("line")).alias("place"), "w.h1", "w.h2")


def later_windows(docs: DataFrame, width: int = WINDOW, short: bool = False) -> DataFrame:
    """__id, __th, __starts: the first lines, in order, of each document's windows that occur earlier elsewhere or in itself."""
    every = windows(docs, width, short)
    repeated = cut(every.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # one window may be in a third of all documents: both sides are plain exchanges, which Spark splits where they are skewed
    later = every.join(repeated, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return later.groupBy(F.col("place.id").alias("__id"), F.col("place.th").alias("__th")).agg(F.array_sort(F.collect_set("place.line")).alias("__starts"))


def dedup_lines(docs: DataFrame, width: int = WINDOW, counts: bool = False, short: bool = False) -> DataFrame:
    """docs with text freed of later occurrences of repeated windows; all columns and rows are kept.

    Null texts (they stay null) and empty texts are left alone, and so are documents with fewer lines than a window unless
    short is set: then all their lines are one window. A document all of whose lines are covered becomes the empty text.
    Equal rows of one doc_id count as one occurrence and come out alike. Columns of any name pass through.
    Rows without doc_id come after all others. counts adds n_lines and n_removed. An empty table gives an empty result.
    """
    key = fresh(docs, "__key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    later = later_windows(docs, width, short)
    joined = rows.join(later, rows["doc_id"].eqNullSafe(later["__id"]) & (rows[key] == later["__th"]), "left")
    lines = _lines(rows["text"])
    starts = later["__starts"]
    none = F.array().cast("array<int>")
    before = F.concat(F.array(F.lit(-width)), F.coalesce(starts, none))
    after = F.concat(F.coalesce(starts, none), F.array(F.size(lines)))
    gaps = F.zip_with(before, after, lambda a, b: F.slice(lines, a + width + 1, F.greatest(b - a - width, F.lit(0))))
    text = F.when(F.isnotnull(starts), F.array_join(F.flatten(gaps), "\n")).otherwise(rows["text"])
    removed = F.aggregate(
        F.zip_with(before, after, lambda a, b: F.greatest(b - a - width, F.lit(0))), F.size(lines), lambda total, kept: total - kept
    )
    columns = [text.alias("text") if c == "text" else rows[c] for c in docs.columns]
    if counts:
        columns += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) AS pos FROM l),
w AS (SELECT doc_id, pos, trim(ls[pos + 1], chr(32) || chr(9) || chr(13)) || chr(10) || trim(ls[pos + 2], chr(32) || chr(9) || chr(13))
        || chr(10) || trim(ls[pos + 3], chr(32) || chr(9) || chr(13)) AS k FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w WHERE k <> chr(10) || chr(10)),
c AS (SELECT DISTINCT doc_id, unnest([pos + 1, pos + 2, pos + 3]) AS line FROM r WHERE n > 1),
g AS (SELECT doc_id, list(line) AS covered FROM c GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN covered IS NULL THEN text
         ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(covered, i)), chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(covered), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN g USING (doc_id)
"""

#: The same with short: a text of one or two lines is a window of all its lines.
ORACLE_SHORT = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 1))) AS pos FROM l WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, least(pos + 3, len(ls)) AS last,
        array_to_string(list_transform(ls[pos + 1 : pos + 3], lambda x: trim(x, chr(32) || chr(9) || chr(13))), chr(10)) AS k FROM p),
r AS (SELECT doc_id, pos, last, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w WHERE replace(k, chr(10), '') <> ''),
c AS (SELECT DISTINCT doc_id, unnest(range(pos + 1, last + 1)) AS line FROM r WHERE n > 1),
g AS (SELECT doc_id, list(line) AS covered FROM c GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN covered IS NULL THEN text
         ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(covered, i)), chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(covered), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN g USING (doc_id)
"""
