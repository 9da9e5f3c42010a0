"""Nearest neighbours of a query set among all rows.

Queries and rows are dealt into a grid: each task holds one group of rows, whose size has a bound, and reads one part of
the queries in blocks. Only what it keeps of a block is shuffled, as the k best of each query in its group, and nothing
passes the driver. All rows as queries of themselves are the same: quadratic work, spread evenly over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries in a block, and distances computed at a time.
BLOCK, CELLS = 2048, 2_000_000
#: Numbers of the vectors that a task holds, groups and tasks of a search if there are LEAST rows for each.
HELD, GROUPS, TASKS, LEAST = 1 << 22, 6, 36, 256


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A matrix of a column of arrays; ValueError where one is null, holds a null or has another length."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten()
    if values.null_count or flat.null_count:
        raise ValueError("a vector is null or holds a null")
    if len(values) and (len(flat) % len(values) or pc.count_distinct(pc.list_value_length(values)).as_py() > 1):
        raise ValueError("vectors differ in length")
    flat = np.asarray(flat.to_numpy(zero_copy_only=False), float)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def complete(df: DataFrame) -> DataFrame:
    """The rows whose vector v is not null and holds no null."""
    return df.where(F.isnotnull("v") & ~F.exists("v", lambda x: F.isnull(x)))


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """A row per query: Euclidean distance, or one minus cosine (1 where a norm is 0)."""
    if metric == "euclidean":
        out = np.empty((len(q), len(x)))
        step = max(1, CELLS // max(1, len(x) * q.shape[1]))
        for at in range(0, len(q), step):
            out[at : at + step] = np.sqrt(((q[at : at + step, None, :] - x[None]) ** 2).sum(axis=2))
        return out
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    return 1 - np.divide(q @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0)


class Screen:
    """Distances of queries to rows by matrix products, and the pairs up to a limit measured exactly.

    Products of single precision say which pairs may lie within the limit: their error has a bound, and so many in doubt
    that it shows are asked again in double precision. Vectors are centred before, so an offset costs no accuracy.
    """

    def __init__(self, x: np.ndarray, metric: str = "euclidean"):
        self.x, self.metric, self.made = x, metric, {}
        if metric == "euclidean":
            whole = x[np.isfinite(x).all(axis=1)]
            self.centre = whole.mean(axis=0) if len(whole) else 0.0
            y = x - self.centre
            self.square = (y**2).sum(axis=1)
            self.sides = np.concatenate((y, self.square[:, None], np.ones((len(x), 1))), axis=1)
            self.longest = np.sqrt(np.nanmax(np.where(np.isfinite(self.square), self.square, 0), initial=0))

    def right(self, kind: type) -> np.ndarray:
        if kind not in self.made:
            self.made[kind] = self.sides.astype(kind)
        return self.made[kind]

    def asked(self, q: np.ndarray) -> Asked:
        return Asked(self, q)


class Asked:
    """A block of queries before a screen's rows."""

    def __init__(self, screen: Screen, q: np.ndarray):
        self.screen, self.q = screen, q
        if screen.metric == "euclidean":
            y = q - screen.centre
            square = (y**2).sum(axis=1)
            self.left = np.concatenate((-2 * y, np.ones((len(q), 1)), square[:, None]), axis=1)
            self.reach = (np.sqrt(square) + screen.longest) ** 2 * (q.shape[1] + 8)
            self.kind = np.float32 if max(square.max(initial=0), screen.longest**2) < 1e30 else np.float64
            self.low = self.left.astype(self.kind)

    def tile(self, of: np.ndarray | slice, a: int, b: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Of some queries the squared distances to rows a to b, and a bound of each query's error; cosine distances have none."""
        if self.screen.metric != "euclidean":
            return distances(self.q[of], self.screen.x[a:b], self.screen.metric), np.zeros(len(self.q[of]))
        left = self.low if kind is self.kind else self.left
        return left[of] @ self.screen.right(kind)[a:b].T, self.reach[of] * np.finfo(kind).eps

    def measured(self, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(query.size)
        step = max(1, CELLS // max(1, self.q.shape[1]))
        for at in range(0, query.size, step):
            out[at : at + step] = np.sqrt(((self.q[query[at : at + step]] - self.screen.x[row[at : at + step]]) ** 2).sum(axis=1))
        return out

    def pairs(self, a: int, b: int, limit: np.ndarray | float | None = None, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the pairs up to limit with rows a to b, and some beyond; without limit of those up to
        the query's k-th distance."""
        plain = self.screen.metric != "euclidean"
        kinds = [np.float64] if plain or self.kind is np.float64 else [np.float32, np.float64]
        for kind in kinds:
            d, error = self.tile(slice(None), a, b, kind)
            most = np.partition(d, k - 1, axis=1)[:, k - 1].astype(float) + error if limit is None else np.broadcast_to(limit if plain else np.square(limit), len(d))
            near = d <= np.nextafter((most + error).astype(kind), np.array(np.inf, kind))[:, None] if not plain else d <= most[:, None]
            found = np.flatnonzero(near)
            if kind is kinds[-1] or found.size <= near.size // 8 or limit is None:
                break
        query, row = np.divmod(found, b - a)
        return query, row + a, d.ravel()[found] if plain else self.measured(query, row + a)

    def within(self, of: np.ndarray, a: int, b: int, limit: float) -> np.ndarray:
        """Which of rows a to b lie within limit of some queries: only those near the limit are measured exactly."""
        for kind in [self.kind] if self.kind is np.float64 else [np.float32, np.float64]:
            d, error = self.tile(of, a, b, kind)
            near, sure = (d <= np.nextafter((limit**2 + e).astype(kind), np.array(np.inf * s, kind))[:, None] for e, s in ((error, 1), (-error, -1)))
            query, row = np.nonzero(near & ~sure)
            if query.size <= near.size // 8:
                break
        near[query, row] = self.measured(np.asarray(of)[query], row + a) <= limit
        return near


#: What a task does with its rows: from their vectors and columns, a function of (query ids, query vectors) that gives
#: columns of results, and one that gives what is left at the end.
Reducer = Callable[[np.ndarray, list[pa.Array]], tuple[Callable[[pa.Array, np.ndarray], Iterable[Sequence]], Callable[[], Iterable[Sequence]]]]


def _nothing() -> Iterable[Sequence]:
    return ()


def scanned(queries: DataFrame, rows: DataFrame, id_col: str, cols: Sequence[str], schema: str, reduce: Reducer, row_id: str, refuse: bool = False) -> DataFrame:
    """What reduce gives for every block of queries before every group of rows.

    cols are the rows' columns beside v that it needs, row_id deals the rows out. Queries and rows without a whole vector
    take no part, or are refused (ValueError).
    """
    own = list(dict.fromkeys([row_id, *cols]))
    queries, rows = queries.select(id_col, "v"), rows.select("v", *own)
    if not refuse:
        queries, rows = complete(queries), complete(rows)
    empty = queries.sparkSession.createDataFrame([], schema)
    kinds = {f.name: to_arrow_type(f.dataType) for f in empty.schema}
    (m, _), (n, wide) = (df.agg(F.count("*"), F.max(F.size("v"))).first() for df in (queries, rows))
    if not m or not n:
        return empty
    groups = max(ceil(n * max(1, wide or 0) / HELD), min(GROUPS, ceil(n / LEAST)))
    parts = min(ceil(m / LEAST), ceil(TASKS / groups))
    groups = max(groups, min(ceil(TASKS / parts), ceil(n / LEAST)))
    block, places = BLOCK, [3 + own.index(c) + 1 for c in cols]
    part, group = (F.pmod(F.xxhash64(F.lit(7), c), F.lit(k)).cast("int") for c, k in ((id_col, parts), (row_id, groups)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select(group.alias("__g"), every(parts).alias("__p"), F.lit(0).alias("__s"), F.lit(None).cast(queries.schema[id_col].dataType).alias("__q"), "v", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(own)])
    right = queries.select(every(groups).alias("__g"), part.alias("__p"), F.lit(1).alias("__s"), F.col(id_col).alias("__q"), "v", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"__c{i}") for i, c in enumerate(own)])
    both = left.unionByName(right).select((F.col("__g") * parts + F.col("__p")).alias("__cell"), "__s", "__q", "v", *[f"__c{i}" for i in range(len(own))])
    dealt = both.repartitionById(groups * parts, F.col("__cell")).sortWithinPartitions("__cell", "__s", "__q")  # rows before queries, and these in order

    def batched(found: Iterable[Sequence]) -> Iterator[pa.RecordBatch]:
        for made in found:
            yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, k in zip(made, kinds.values(), strict=True)], names=list(kinds))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, waiting, step, end = None, [], [], None, _nothing

        def asked() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, step, end, held
            if step is None:
                whole = pa.Table.from_batches(held)
                step, end = reduce(_vectors(whole.column(3)), [whole.column(i).combine_chunks() for i in places])
                held = []
            whole, waiting = pa.Table.from_batches(waiting), []
            for at in range(0, whole.num_rows, block):
                some = whole.slice(at, block)
                yield from batched(step(some.column(2).combine_chunks(), _vectors(some.column(3))))

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if key[a] // 2 != cell:
                    if waiting and (held or step):
                        yield from asked()
                    yield from batched(end())
                    cell, held, waiting, step, end = key[a] // 2, [], [], None, _nothing
                (waiting if key[a] % 2 else held).append(batch.slice(a, b - a))
                if (held or step) and sum(w.num_rows for w in waiting) >= block:
                    yield from asked()
        if waiting and (held or step):
            yield from asked()
        yield from batched(end())

    return dealt.mapInArrow(kernel, schema)


def _pair_schema(queries: DataFrame, rows: DataFrame, id_col: str, row_id: str, keep: Sequence[str]) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return ", ".join([f"{id_col} {kind(queries, id_col)}", f"{row_id} {kind(rows, row_id)}", "distance double", *[f"{c} {kind(rows, c)}" for c in keep]])


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str, row_id: str, keep: Sequence[str] = (), metric: str = "euclidean") -> DataFrame:
    """The k nearest rows of each query: id_col, row_id, distance, rank from 1 and the kept columns.

    Both frames have their vector in v. Of equal distances the smaller row_id is nearer; a query that is among the rows is
    its own neighbour. What has no vector, or a null in it, has no neighbours and is none.
    """
    cells = CELLS

    def best(x: np.ndarray, columns: list[pa.Array]) -> tuple:
        screen, n = Screen(x, metric), len(x)
        ids = columns[0].to_numpy(zero_copy_only=False)
        order_of = ids if ids.dtype.kind in "iuf" else np.unique(ids, return_inverse=True)[1]

        def step(asked: pa.Array, q: np.ndarray) -> Iterator[Sequence]:
            block, m = screen.asked(q), len(q)
            limit, query, row, d = np.full(m, np.inf), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            at, wide = 0, min(n, max(4 * k, 512))
            while at < n:
                to = min(n, at + wide)
                new = block.pairs(at, to, limit) if at else block.pairs(at, to, None, min(k, to))
                at, wide = to, max(k, cells // m)
                if new[0].size:
                    hit = np.zeros(m, bool)
                    hit[new[0]] = True
                    again = hit[query]
                    some = [np.concatenate((old[again], added)) for old, added in zip((query, row, d), new, strict=True)]
                    order = np.lexsort((order_of[some[1]], some[2], some[0]))
                    some = [c[order] for c in some]
                    rank = np.arange(order.size) - np.searchsorted(some[0], some[0])  # from where the query's pairs begin
                    limit[some[0][rank == k - 1]] = some[2][rank == k - 1]
                    query, row, d = (np.concatenate((old[~again], c[rank < k])) for old, c in zip((query, row, d), some, strict=True))
            picked = pa.array(row)
            yield [asked.take(pa.array(query)), columns[0].take(picked), d, *[c.take(picked) for c in columns[1:]]]

        return step, _nothing

    found = scanned(queries, rows, id_col, [row_id, *keep], _pair_schema(queries, rows, id_col, row_id, keep), best, row_id)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("distance", row_id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def within(queries: DataFrame, rows: DataFrame, radius: float, id_col: str, row_id: str, keep: Sequence[str] = (), metric: str = "euclidean") -> DataFrame:
    """All rows within radius (inclusive) of each query."""
    cells = CELLS // 8  # all of them may be within

    def all_near(x: np.ndarray, columns: list[pa.Array]) -> tuple:
        screen = Screen(x, metric)

        def step(asked: pa.Array, q: np.ndarray) -> Iterator[Sequence]:
            block = screen.asked(q)
            wide = max(1, cells // len(q))
            for at in range(0, len(x), wide):
                query, row, d = block.pairs(at, min(len(x), at + wide), radius)
                near = d <= radius
                picked = pa.array(row[near])
                yield [asked.take(pa.array(query[near])), columns[0].take(picked), d[near], *[c.take(picked) for c in columns[1:]]]

        return step, _nothing

    return scanned(queries, rows, id_col, [row_id, *keep], _pair_schema(queries, rows, id_col, row_id, keep), all_near, row_id)


def vote(pairs: DataFrame, id_col: str, label: str) -> DataFrame:
    """The most frequent label of each query's neighbours, of ties the smallest, as prediction."""
    counts = pairs.groupBy(id_col, label).count()
    best = F.max_by(label, F.struct("count", (-F.col(label)).alias("small")))
    return counts.groupBy(id_col).agg(best.alias("prediction"))


def knn_classify(queries: DataFrame, train: DataFrame, id_col: str, train_id: str, label: str, n_neighbors: int = 5) -> DataFrame:
    """Majority label (integers) among the nearest training rows."""
    return vote(nearest(queries, train, n_neighbors, id_col, train_id, [label]), id_col, label)


def knn_regress(queries: DataFrame, train: DataFrame, id_col: str, train_id: str, target: str, n_neighbors: int = 5) -> DataFrame:
    """Mean target of the nearest training rows."""
    return nearest(queries, train, n_neighbors, id_col, train_id, [target]).groupBy(id_col).agg(F.avg(target).alias("prediction"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norms = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) for v in (a, b)]
    return F.when((norms[0] == 0) | (norms[1] == 0), F.lit(0.0)).otherwise(dot / F.nullif(norms[0] * norms[1], F.lit(0.0)))


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, id_col: str, row_id: str) -> DataFrame:
    """The k most similar rows of each query by cosine: similarity and rank."""
    found = nearest(queries, rows, k, id_col, row_id, metric="cosine")
    return found.select(id_col, row_id, (1 - F.col("distance")).alias("similarity"), "rank")
