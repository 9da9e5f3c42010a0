"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

Two fingerprints that differ in at most RADIUS = 3 of 64 bits differ in at most 3 of 6 blocks, so they agree on 3 blocks
at least. Every fingerprint therefore gets one key for each choice of 3 blocks (20 keys of about 32 bits), and close
pairs meet under a key. Exact copies collapse to one fingerprint beforehand. Under a key a spanning forest of the
verified links is kept, never all pairs. A key with more than GROUP_LIMIT fingerprints is split once more in the same
way over the 32 bits that are left; 48 bits are then fixed, so no group can exceed 2**16 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, fresh, spread_join

RADIUS = 3
GROUP_LIMIT = 1 << 16
#: (first bit, bits) of each block.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
CHOICES = list(combinations(range(6), 3))
MAX_SHINGLES = 200_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the XXH64 of its word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, MAX_SHINGLES):
        spans = zip(starts[at : min(n, at + MAX_SHINGLES)].tolist(), last[at : at + MAX_SHINGLES].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, th (digest of the text) and fp (fingerprint as a signed long) of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            found = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], names=["doc_id", "th", "fp"])

    source = docs.select("doc_id", F.col("text").cast("string"), F.xxhash64("text").alias("th"))
    return source.mapInArrow(kernel, source.select("doc_id", "th", F.lit(0).cast("long").alias("fp")).schema)


def block_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): 20 keys of each fingerprint, the number of the choice above the bits of its three blocks."""
    keys = []
    for i, chosen in enumerate(CHOICES):
        key, shift = F.lit(i << 33), 0
        for b in chosen:
            first, bits = BLOCKS[b]
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            key, shift = key.bitwiseOR(F.shiftleft(part, shift)), shift + bits
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def split_keys(rows: DataFrame) -> DataFrame:
    """(key, fp) of oversized groups under finer keys: the three blocks that were free are halved, and three halves fixed."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            choice = key >> 33
            for i in np.unique(choice).tolist():
                own = fp[choice == i]
                halves = []
                for b in sorted(set(range(6)) - set(CHOICES[i])):
                    first, bits = BLOCKS[b]
                    halves += [(first, bits // 2), (first + bits // 2, bits - bits // 2)]
                fixed = sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in CHOICES[i])
                for j, chosen in enumerate(CHOICES):
                    mask = fixed | sum(((1 << halves[h][1]) - 1) << halves[h][0] for h in chosen)
                    tag = np.full(own.size, i * len(CHOICES) + j, np.int32)
                    kept = (own & np.uint64(mask)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(kept), pa.array(own.view(np.int64))], names=["tag", "key", "fp"])

    return rows.select("key", "fp").mapInArrow(kernel, "tag int, key long, fp long")


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (root, member) that join exactly the groups which links of at most radius bits make among fps."""
    links, left = [], fps
    while left.size > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and left.size:
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                links += [(root, x) for x in found]
    return links


def group_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of the spanning forest under every key. Groups are at most 2**16 fingerprints.

    The rows are kept first: right above a join on the keys Spark would leave out exchange and sort, as the join has both,
    and then might broadcast the join, so that the rows of a key no longer come one after another.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fp: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            links = [x for part in np.split(fp, cuts) for x in forest(part)]
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            columns = [np.concatenate(x) for x in zip(*held, columns, strict=True)] if held else columns
            change = np.zeros(columns[0].size - 1, bool)
            for k in columns[:-1]:
                change |= k[1:] != k[:-1]
            cuts = np.flatnonzero(change) + 1
            if cuts.size:
                yield flush(columns[-1][: cuts[-1]].view(np.uint64), cuts[:-1])
                columns = [c[cuts[-1] :] for c in columns]
            held = [columns]
        if held:
            yield flush(held[0][-1].view(np.uint64), np.array([], int))

    sorted_rows = cut(rows.select(*keys, "fp")).repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(kernel, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints; their groups are those of all pairs within RADIUS bits.

    fps: column fp, each value once.
    """
    keyed = block_keys(fps)
    groups = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = groups.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    members = keyed.join(groups.where("n > 2").select("key", "n"), "key")
    small = group_links(members.where(F.col("n") <= GROUP_LIMIT), ["key"])
    large = group_links(split_keys(members.where(F.col("n") > GROUP_LIMIT)), ["tag", "key"])
    return pairs.unionByName(small).unionByName(large)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches, by alternating large and small stars.

    Each round hangs the larger neighbours of a node, then the smaller ones, on its smallest neighbour, until nothing
    changes; the number of rounds grows as the logarithm of the nodes.
    """

    def canonical(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = cut(canonical(edges))
    before = state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = canonical(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut(canonical(small.unionByName(low.withColumnRenamed("m", "b"))))
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Every row's group of near duplicates.

    Returns doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id that can be reached over links of at
    most RADIUS bits, th (digest of the text) and root (one fingerprint of the group). Null and empty texts have fingerprint zero and link like any other. A null doc_id takes part;
    component_id is null only if no row of the group has a doc_id. Repeated rows stay repeated. Columns other than doc_id
    and text are not looked at. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, width, seed))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(fps.select("fp")))
    placed = cut(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = spread_join(placed.select("root", "fp"), ids, "root")
    return spread_join(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "th", "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest doc_id, of equal ones the smallest text digest.

    All columns are kept. Equal rows of one doc_id count as one document.
    """
    groups = near_duplicates(docs)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("late"), "doc_id", "th")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"))
    key = fresh(docs, "__key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    found = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows[key] == kept["__th"]), "left_semi")
    return found.dropDuplicates(["doc_id", key]).drop(key)
