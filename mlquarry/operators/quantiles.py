"""Exact quantiles and modes without holding all values of a column in one place.

A rank is found by narrowing the interval that it lies in: approximate quantiles, which are small and merge, give two
values near the rank, and counting the rows below, at, between and above them says where to go on. Each round leaves about
a thousandth of the rows, and an interval of at most FEW rows is read out. All columns and ranks share the scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an interval that the driver takes, accuracy of the approximate quantiles, aggregates in one scan.
FEW, ACCURACY, PER_JOB = 4096, 2000, 300


def _row(df: DataFrame, wanted: list[Column]) -> list:
    out: list = []
    for at in range(0, len(wanted), PER_JOB):
        out += df.agg(*[w.alias(f"a{i}") for i, w in enumerate(wanted[at : at + PER_JOB])]).first()
    return out


class _Interval:
    """The values of a column between low and high (both outside; None: no bound), and how many rows are not above low."""

    def __init__(self, column: Column, below: int, inside: int, low: float | None = None, high: float | None = None):
        self.column, self.below, self.inside, self.low, self.high = column, below, inside, low, high

    def values(self) -> Column:
        test = F.isnotnull(self.column)
        if self.low is not None:
            test &= self.column > F.lit(self.low)
        if self.high is not None:
            test &= self.column < F.lit(self.high)
        return F.when(test, self.column)

    def probe(self, ranks: Sequence[int]) -> Column:
        """For each rank of the column two values near it, on either side where the interval is large."""
        places, reach = [(r - self.below) / max(1, self.inside - 1) for r in ranks], 2 / ACCURACY
        sides = [min(1.0, max(0.0, x)) for at in places for x in (at - reach, at + reach)]
        return F.percentile_approx(self.values(), F.array(*map(F.lit, sides)), F.lit(ACCURACY))

    def counts(self, a: float, b: float) -> list[Column]:
        v = self.values()
        return [F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & F.lit(a != b))]

    def narrowed(self, rank: int, a: float, b: float, n: Sequence[int]) -> float | _Interval:
        """The value of the rank, or the smaller interval that holds it."""
        at, k = rank - self.below, 0
        parts = [(n[0], self.low, a), (n[1], a, None), (n[2], a, b), (n[3], b, None), (self.inside - sum(n), b, self.high)]
        for i, (size, low, high) in enumerate(parts):
            if at < k + size:
                return low if i in (1, 3) else _Interval(self.column, self.below + k, size, low, high)
            k += size
        raise RuntimeError("the column changed between two scans")


def order_statistics(df: DataFrame, ranks: Sequence[tuple[Column, Sequence[int]]], sizes: Sequence[int]) -> list[dict[int, float]]:
    """For each column, of which sizes are not null, the values of its ranks from 0 in ascending order."""
    found: list[dict[int, float]] = [{} for _ in ranks]
    open_ = {(i, r): _Interval(c, 0, sizes[i]) for i, (c, own) in enumerate(ranks) for r in sorted(set(own)) if 0 <= r < sizes[i]}
    while open_:
        shared: dict[tuple, tuple[_Interval, list[int]]] = {}  # ranks of one column that are in one interval
        for (i, r), x in open_.items():
            shared.setdefault((x.inside > FEW, i, x.low, x.high), (x, []))[1].append(r)
        asked = [x.probe(own) if key[0] else F.sort_array(F.collect_list(x.values())) for key, (x, own) in shared.items()]
        open_, sides = {}, {}
        for (large, i, *_), (x, own), values in zip(shared, shared.values(), _row(df, asked), strict=True):
            for k, r in enumerate(own):
                if large:
                    sides.setdefault((i, x.low, x.high, values[2 * k], values[2 * k + 1]), (x, []))[1].append(r)
                else:
                    found[i][r] = values[r - x.below]
        counted = _row(df, [c for key, (x, _) in sides.items() for c in x.counts(*key[3:])])
        for j, ((i, *_, a, b), (x, own)) in enumerate(sides.items()):
            for r in own:
                to = x.narrowed(r, a, b, counted[4 * j : 4 * j + 4])
                if isinstance(to, _Interval):
                    open_[i, r] = to
                else:
                    found[i][r] = to
    return found


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, float | Sequence[float]]]) -> dict[str, float | list[float] | None]:
    """Exact quantiles with linear interpolation, by name: columns of doubles and one probability or several.

    None for a column without values; null and missing values do not count.
    """
    names = list(wanted)
    sizes = _row(df, [F.count(wanted[n][0]) for n in names])
    shares = {n: [p] if isinstance(p := wanted[n][1], (int, float)) else list(p) for n in names}
    places = [[p * (size - 1) for p in shares[n]] for n, size in zip(names, sizes, strict=True)]
    ranks = [(wanted[n][0], [r for x in own for r in (floor(x), ceil(x))]) for n, own in zip(names, places, strict=True)]
    found = order_statistics(df, ranks, sizes)
    out: dict[str, float | list[float] | None] = {}
    for n, own, values, size in zip(names, places, found, sizes, strict=True):
        made = [(ceil(x) - x) * values[floor(x)] + (x - floor(x)) * values[ceil(x)] if ceil(x) > floor(x) else values[floor(x)] for x in own] if size else None
        out[n] = made if made is None or not isinstance(wanted[n][1], (int, float)) else made[0]
    return out


def quantile(df: DataFrame, column: str | Column, p: float) -> float | None:
    """One exact quantile of a column."""
    return quantiles(df, {"q": ((F.col(column) if isinstance(column, str) else column).cast("double"), p)})["q"]


def modes(df: DataFrame, wanted: Mapping[str, Column]) -> dict[str, float | None]:
    """The most frequent value of each column, of ties the smallest; None for a column without values."""
    names = list(wanted)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), wanted[n].alias("x")) for i, n in enumerate(names)])
    counts = df.select(F.inline(pairs)).where("x is not null").groupBy("i", "x").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.max_by("x", F.struct("n", (-F.col("x")).alias("s"))).alias("x"))
    found = {r.i: r.x for r in best.collect()}
    return {n: found.get(i) for i, n in enumerate(names)}
