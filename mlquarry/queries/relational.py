"""Relational idioms that the operators rest on, each as a query of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Registry, r6, read

query = Registry()


@query("anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(urgent, customers.c_custkey == urgent.o_custkey, "left_anti")


@query(
    "asof_join",
    "WITH e AS (SELECT *, CAST(event_type = 'purchase' AS INT) AS p FROM events) SELECT e.event_id, (SELECT max(v.ts) FROM e v WHERE v.user_id = e.user_id AND v.p = 0 AND v.ts < e.ts) AS seen FROM e WHERE p = 1",
)
def asof_join(spark, sf_dir):
    """The last other event of a user before each purchase: one window over the user's events instead of a join."""
    events = read(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = events.select("event_id", "user_id", "event_type", micros.alias("ts"), F.col("ts").alias("at"))
    last = F.max(F.when(F.col("event_type") != "purchase", F.col("at"))).over(before)
    return marked.withColumn("seen", last).where("event_type = 'purchase'").select("event_id", "seen")


@query(
    "interval_join",
    "SELECT a.event_id AS event_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click'",
)
def interval_join(spark, sf_dir):
    """Events of a user within the hour after a click, joined by user and hour so that no user's pairs meet in full."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = 3_600_000_000
    left = events.where("event_type = 'click'").select(F.col("event_id"), F.col("user_id").alias("u"), F.col("t").alias("a"), F.floor(F.col("t") / hour).alias("h"))
    hours = F.explode(F.array(F.floor(F.col("t") / hour), F.floor(F.col("t") / hour) - 1)).alias("h")
    right = events.select(F.col("event_id").alias("other_id"), F.col("user_id").alias("u"), F.col("t").alias("b"), hours)
    return left.join(right, ["u", "h"]).where((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + hour)).select("event_id", "other_id")


@query(
    "grouping_sets",
    "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10",
)
def grouping_sets(spark, sf_dir):
    """Totals by both, either and neither column."""
    cube = read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return cube.where("n > 10").select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("sample_by_digest", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10")
def sample_by_digest(spark, sf_dir):
    """A tenth of the orders that is the same at every run and on every cluster."""
    bucket = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return read(spark, sf_dir, "orders").where(bucket < 10).select("o_orderkey")


SETS = "a AS (SELECT DISTINCT p_type AS t FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_type AS t FROM part WHERE p_size > 45)"


@query(
    "set_operations",
    f"WITH {SETS} SELECT 'intersect' AS kind, t FROM (SELECT t FROM a INTERSECT SELECT t FROM b) UNION ALL SELECT 'except', t FROM (SELECT t FROM a EXCEPT SELECT t FROM b) UNION ALL SELECT 'symmetric', t FROM ((SELECT t FROM a EXCEPT SELECT t FROM b) UNION (SELECT t FROM b EXCEPT SELECT t FROM a)) UNION ALL SELECT 'all', t FROM (SELECT t FROM a UNION ALL SELECT t FROM b)",
)
def set_operations(spark, sf_dir):
    """Part types of small and of large parts."""
    part = read(spark, sf_dir, "part")
    a, b = (part.where(w).select(F.col("p_type").alias("t")).distinct() for w in ("p_size < 10", "p_size > 45"))
    made = {"intersect": a.intersect(b), "except": a.exceptAll(b), "symmetric": a.exceptAll(b).unionByName(b.exceptAll(a)), "all": a.unionByName(b)}
    out = None
    for kind, df in made.items():
        rows = df.select(F.lit(kind).alias("kind"), "t")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "calendar",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, min(dayofyear(o_orderdate))::INTEGER AS first_day, max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::INTEGER AS last, sum(CAST(isodow(o_orderdate) > 5 AS INT))::BIGINT AS weekend FROM orders GROUP BY 1",
)
def calendar(spark, sf_dir):
    """Orders by month, with days of the year, distances in days and weekends."""
    at = F.col("o_orderdate")
    return (
        read(spark, sf_dir, "orders").groupBy(F.date_format(at, "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"), F.min(F.dayofyear(at)).alias("first_day"), F.max(F.date_diff(at.cast("date"), F.lit("1992-01-01").cast("date"))).alias("last"), F.count_if(F.weekday(at) > 4).alias("weekend"))
    )


@query("json_fields", "SELECT event_type, k, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1, 2")
def json_fields(spark, sf_dir):
    """A field of a JSON column, read by schema."""
    k = F.from_json("props", "k int")["k"].alias("k")
    return read(spark, sf_dir, "events").select("event_type", "value", k).groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("map_lookup", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def map_lookup(spark, sf_dir):
    """Counts of each user's few kinds of events as a map, and a look into it."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    return maps.select("user_id", F.coalesce(F.col("m")["click"], F.lit(0)).alias("clicks"), F.map_keys("m").alias("k")).select("user_id", "clicks", F.size("k").cast("long").alias("kinds"))


@query("user_function", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def user_function(spark, sf_dir):
    """A user's own vectorised function of columns."""

    @F.pandas_udf("double")
    def charge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for price, discount, tax in batches:
            yield price * (1 - discount) * (1 + tax)

    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(charge("l_extendedprice", "l_discount", "l_tax")).alias("charge"))


@query("user_aggregate", "SELECT l_returnflag, round(pow(10, avg(log10(l_quantity))), 6) AS geometric FROM lineitem GROUP BY 1")
def user_aggregate(spark, sf_dir):
    """A user's own aggregate in two parts that merge: each task reduces its rows, and only sums are shuffled."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in batches:
            logs = np.log10(frame["l_quantity"])
            yield pd.DataFrame({"l_returnflag": frame["l_returnflag"], "s": logs, "n": 1}).groupby("l_returnflag", as_index=False).sum()

    parts = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity").mapInPandas(part, "l_returnflag string, s double, n long")
    return parts.groupBy("l_returnflag").agg(r6(F.pow(F.lit(10.0), F.sum("s") / F.sum("n"))).alias("geometric"))


@query("user_table_function", "SELECT p_partkey, i - 1 AS i, w AS word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part)")
def user_table_function(spark, sf_dir):
    """A user's own function from a row to rows."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(k, i, w) for k, t in zip(frame["p_partkey"], frame["p_type"], strict=True) for i, w in enumerate(t.split(" "))]
            yield pd.DataFrame(rows, columns=["p_partkey", "i", "word"])

    return read(spark, sf_dir, "part").select("p_partkey", "p_type").mapInPandas(words, "p_partkey long, i long, word string")


QUERIES, ORACLE_SQL = query.queries, query.sql
