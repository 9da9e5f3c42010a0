"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python kernel takes at a time, whatever the size of the Arrow batch.
CHUNK_CHARS = 1_000_000
#: Copies of the smaller side in a join whose key may hold a third of the rows.
SPREAD = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a folder of our own only where the session names
    none and all of Spark runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="mlquarry-"))
    return found or context._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, through the file system that its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that losing an executor costs nothing that came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salt: list[str] | None = None) -> DataFrame:
    """Equi-join on key where the left side may repeat one key without bound and the right side has each key once.

    Left rows of a key go to SPREAD partitions by the columns salt (all of them if not given), and each right row to all.
    """
    at = fresh(left, fresh(right, "__salt"))
    part = F.pmod(F.xxhash64(*[left[c] for c in salt or left.columns]), F.lit(SPREAD)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(SPREAD)]))
    return left.withColumn(at, part).join(right.withColumn(at, copies), [key, at], how).drop(at)


def text_hash(text: Column | str) -> Column:
    """A 64-bit digest that tells rows of one doc_id apart; null and empty texts differ."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about CHUNK_CHARS bytes of text; one long text is a piece of its own."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        start = total = 0
        for i, value in enumerate(pc.fill_null(pc.binary_length(sizes), 0).to_pylist()):
            if total and total + value > CHUNK_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += value
        if start < batch.num_rows:
            yield batch.slice(start)


def empty_text(values: Iterable[str | None]) -> list[str]:
    return [v or "" for v in values]
