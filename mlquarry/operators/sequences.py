"""Windows over ordered sequences: frames of a video, samples of a signal, values of a user's events.

Frames come as (sequence, position, values) with an array of numbers a frame, or a number a position. Every sequence is
a window partition of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(seq: str, pos: str):
    return Window.partitionBy(seq).orderBy(pos)


def mean_of(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean of the absolute differences of two arrays."""
    return mean_of(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def frame_differences(df: DataFrame, seq: str, pos: str, value: str) -> DataFrame:
    """difference to the value before; null at the first."""
    return df.withColumn("difference", F.col(value) - F.lag(value).over(_order(seq, pos)))


def keyframes(df: DataFrame, seq: str, pos: str, frame: str, threshold: float = 0.2) -> DataFrame:
    """The first frame of a sequence and those whose mean absolute difference to the one before is above the threshold."""
    d = mean_difference(F.col(frame), F.lag(frame).over(_order(seq, pos)))
    return df.withColumn("change", d).where(F.isnull("change") | (F.col("change") > threshold))


def histogram(frame: Column, bins: int = 256, low: float = 0.0, high: float = 256.0) -> Column:
    """Shares of an array's values in equal bins from low to high; the upper end belongs to the last bin."""
    width = (high - low) / bins
    inside = F.filter(frame, lambda v: (v >= low) & (v <= high))
    places = F.transform(inside, lambda v: F.least(F.floor((v.cast("double") - low) / width), F.lit(bins - 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_divide(F.size(F.filter(places, lambda p: p == b)).cast("double"), F.size(places)), F.lit(0.0)))


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)^2 / (a + b + 1e-10) over two histograms."""
    return 0.5 * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + 1e-10)), F.lit(0.0), lambda s, v: s + v)


def structural_similarity(a: Column, b: Column, c1: float = 6.5025, c2: float = 58.5225) -> Column:
    """The similarity of two frames from their means, variances and covariance as wholes."""
    ma, mb = mean_of(a), mean_of(b)
    va = mean_of(F.transform(a, lambda v: (v - ma) * (v - ma)))
    vb = mean_of(F.transform(b, lambda v: (v - mb) * (v - mb)))
    cov = mean_of(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def scene_distances(df: DataFrame, seq: str, pos: str, frame: str, method: str = "histogram", bins: int = 256) -> DataFrame:
    """distance of each frame to the one before by histogram, pixels or structure; null at the first."""
    w = _order(seq, pos)
    if method == "histogram":
        hist = df.withColumn("__h", histogram(F.col(frame), bins))
        return hist.withColumn("distance", chi_square(F.lag("__h").over(w), F.col("__h"))).drop("__h")
    before = F.lag(frame).over(w)
    d = mean_difference(F.col(frame), before) if method == "pixel" else 1 - structural_similarity(before, F.col(frame))
    return df.withColumn("distance", d)


def scenes(df: DataFrame, seq: str, pos: str, frame: str, threshold: float = 0.5, method: str = "histogram", bins: int = 256) -> DataFrame:
    """The frames at which a scene begins: the first, and those further than the threshold from the one before."""
    return scene_distances(df, seq, pos, frame, method, bins).where(F.isnull("distance") | (F.col("distance") > threshold))


def transitions(df: DataFrame, seq: str, pos: str, distance: str, window: int = 5, threshold: float = 0.3) -> DataFrame:
    """Rows where the mean of the next window distances, the own included, differs from that of the window before by more
    than the threshold; rows without a full window before are none."""
    w = _order(seq, pos)
    before = F.avg(distance).over(w.rowsBetween(-window, -1))
    after = F.avg(distance).over(w.rowsBetween(0, window - 1))
    n = F.count(distance).over(w.rowsBetween(-window, -1))
    return df.withColumn("shift", F.when(n == window, F.abs(after - before))).where(F.col("shift") > threshold)


def adaptive_boundaries(df: DataFrame, seq: str, distance: str, k: float = 2.0) -> DataFrame:
    """Rows whose distance exceeds its sequence's mean by k population deviations."""
    w = Window.partitionBy(seq)
    return df.withColumn("limit", F.avg(distance).over(w) + k * F.stddev_pop(distance).over(w)).where(F.col(distance) > F.col("limit"))


def two_pass_boundaries(df: DataFrame, seq: str, pos: str, value: str, threshold1: float = 0.3, threshold2: float = 0.7) -> DataFrame:
    """(seq, kept): positions whose change is above threshold1 and whose value differs from that of the position kept last
    by more than threshold2; a fold over each sequence's candidates."""
    w = _order(seq, pos)
    change = F.abs(F.col(value) - F.lag(value).over(w))
    marked = df.withColumn("__c", F.coalesce(change > threshold1, F.lit(True))).where("__c")
    points = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<{df.schema[pos].dataType.simpleString()}>").alias("kept"))

    def merge(s: Column, p: Column) -> Column:
        far = F.isnull(s["last"]) | (F.abs(p["v"] - s["last"]) > threshold2)
        return F.when(far, F.struct(p["v"].alias("last"), F.concat(s["kept"], F.array(p["p"])).alias("kept"))).otherwise(s)

    return marked.groupBy(seq).agg(points.alias("p")).select(seq, F.aggregate("p", start, merge)["kept"].alias("kept"))


def brightness_events(df: DataFrame, frame: str, flash: float = 0.9, black: float = 0.1, scale: float = 255.0) -> DataFrame:
    """flash: mean brightness above flash or below 1 - flash; black: below black."""
    b = mean_of(F.col(frame)) / scale
    return df.withColumn("brightness", b).withColumn("flash", (b > flash) | (b < 1 - flash)).withColumn("black", b < black)


def rolling_variance(df: DataFrame, seq: str, pos: str, value: str, window: int = 3) -> DataFrame:
    """variance over the positions from window before to window after."""
    return df.withColumn("variance", F.var_pop(value).over(_order(seq, pos).rowsBetween(-window, window)))


def motion_energy(df: DataFrame, seq: str, pos: str, frame: str) -> DataFrame:
    """energy: mean squared difference to the frame before; null at the first."""
    d = mean_of(F.zip_with(F.col(frame), F.lag(frame).over(_order(seq, pos)), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))
    return df.withColumn("energy", d)


def frame_statistics(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """mean, population deviation, least, largest and median value of each frame."""
    rows = df.select(*keys, F.explode(frame).alias("x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.median("x").alias("median"))


def temporal_shift(df: DataFrame, seq: str, pos: str, shift: int = 1) -> DataFrame:
    """Positions (from 0, gapless) moved by shift, round the end."""
    n = F.count("*").over(Window.partitionBy(seq))
    return df.withColumn(pos, F.pmod(F.col(pos) + shift, n))


def reverse_temporal(df: DataFrame, seq: str, pos: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(seq))
    return df.withColumn(pos, n - 1 - F.col(pos))


def interpolated(df: DataFrame, seq: str, pos: str, value: str, factor: int = 2) -> DataFrame:
    """factor - 1 linear steps between neighbours; positions become multiples of the factor."""
    following = F.lead(value).over(_order(seq, pos))
    rows = df.select(seq, (F.col(pos) * factor).alias(pos), F.col(value).cast("double").alias(value), following.alias("__n"))
    steps = F.when(F.isnull("__n"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    out = rows.withColumn("__k", F.explode(steps))
    return out.select(seq, (F.col(pos) + F.col("__k")).alias(pos), F.coalesce(F.col(value) + (F.col("__n") - F.col(value)) * F.col("__k") / factor, F.col(value)).alias(value))


def framed(signal: Column, length: int, hop: int) -> Column:
    """The frames of an array: length values each, hop apart; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(signal) - length + 1, F.lit(1)), F.lit(hop))
    return F.when(F.size(signal) >= length, F.transform(starts, lambda s: F.slice(signal, s, F.lit(length)))).otherwise(F.array().cast("array<array<double>>"))


def energy(frame: Column) -> Column:
    return F.aggregate(frame, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def zero_crossing_rate(frame: Column) -> Column:
    """Share of a frame's steps that change sign, over its length."""
    sign = F.transform(frame, lambda x: F.signum(x.cast("double")))
    turns = F.zip_with(F.slice(sign, F.lit(2), F.greatest(F.size(sign) - 1, F.lit(0))), F.slice(sign, F.lit(1), F.greatest(F.size(sign) - 1, F.lit(0))), lambda a, b: F.when(a != b, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.try_divide(F.aggregate(turns, F.lit(0.0), lambda s, x: s + x), F.size(frame))


def signal_statistics(signal: Column) -> dict[str, Column]:
    """Mean, root mean square, peak and crest factor of an array."""
    rms = F.sqrt(F.try_divide(energy(signal), F.size(signal)))
    peak = F.array_max(F.transform(signal, lambda x: F.abs(x.cast("double"))))
    return {"mean": mean_of(signal), "rms": rms, "peak": peak, "crest": peak / (rms + 1e-10)}


def silent(frame: Column, threshold_db: float = -40.0) -> Column:
    return 10 * F.log10(energy(frame) + 1e-10) < threshold_db


def signal_to_noise(signal: Column, noise: Column) -> Column:
    """In decibels, of the mean powers."""
    return 10 * F.log10(F.try_divide(energy(signal), F.size(signal)) / (F.try_divide(energy(noise), F.size(noise)) + 1e-10))


def mixed(a: Column, b: Column, weight_a: float = 0.5, weight_b: float = 0.5) -> Column:
    """Two signals added with weights, the shorter filled with zeros, brought back to a peak of 1 if above."""
    total = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * weight_a + F.coalesce(y, F.lit(0.0)) * weight_b)
    peak = F.array_max(F.transform(total, F.abs))
    return F.when(peak > 1, F.transform(total, lambda x: x / peak)).otherwise(total)


def shifted(signal: Column, by: int) -> Column:
    """The array rolled by so many places."""
    k = F.pmod(F.lit(-by), F.greatest(F.size(signal), F.lit(1))).cast("int")
    return F.concat(F.slice(signal, k + 1, F.size(signal) - k), F.slice(signal, F.lit(1), k))


def echoed(signal: Column, delay: int, decay: float = 0.5) -> Column:
    """The array plus itself delay places later, at decay."""
    return F.transform(signal, lambda x, i: x + F.when(i >= delay, F.get(signal, i - delay)).otherwise(F.lit(0.0)) * decay)


def tremolo(signal: Column, sample_rate: int, rate: float = 5.0, depth: float = 0.5) -> Column:
    return F.transform(signal, lambda x, i: x * (1 - depth + depth * (1 + F.sin(2 * 3.141592653589793 * rate * i / sample_rate)) / 2))


def temporal_coherence(df: DataFrame, seq: str, pos: str, frame: str, window: int = 3) -> DataFrame:
    """coherence: the mean over the frame's numbers of their variance in the frames from window before to window after.
    Frames nearer to an end have the value of the first or last that has all of these; null if there is none."""
    w = _order(seq, pos)
    near = F.collect_list(frame).over(w.rowsBetween(-window, window))
    numbers = F.transform(F.sequence(F.lit(0), F.size(frame) - 1), lambda i: F.transform("__near", lambda f: F.get(f, i).cast("double")))

    def variance(values: Column) -> Column:
        mean = mean_of(values)
        return mean_of(F.transform(values, lambda x: (x - mean) * (x - mean)))

    inner = F.when(F.size("__near") == 2 * window + 1, mean_of(F.transform(numbers, variance)))
    first = F.first("__inner", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last("__inner", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__near", near).withColumn("__inner", inner).withColumn("coherence", F.coalesce("__inner", first, last)).drop("__near", "__inner")


def _draw(*columns: str | Column) -> Column:
    """A number from 0 to below 2^32 that only depends on the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])), 1, 8), 16, 10).cast("long")


def temporal_dropout(df: DataFrame, seq: str, pos: str, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """The frames whose draw is not below the rate."""
    return df.where(_draw(seq, pos, F.lit(str(seed))) >= int(rate * 2**32))


def temporal_crop(df: DataFrame, seq: str, pos: str, length: int, seed: int = 0) -> DataFrame:
    """length frames in a row of each sequence from a drawn one on; shorter sequences stay whole."""
    w = Window.partitionBy(seq)
    start = _draw(seq, F.lit(str(seed))) % F.greatest(F.lit(1), F.col("__n") - length + 1)
    placed = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(_order(seq, pos)) - 1)
    return placed.where((F.col("__r") >= start) & (F.col("__r") < start + length)).drop("__n", "__r")


def exponential_mean(df: DataFrame, seq: str, pos: str, value: str, momentum: float = 0.1, chunk: int = 1024) -> DataFrame:
    """mean: (1 - momentum) times the mean before, which is 0 at first, plus momentum times the value; a missing value counts as 0.

    A sequence is folded in chunks of rows; only the chunks' last means are folded over the whole sequence, so no row
    holds more than a chunk or a number a chunk.
    """
    keep = 1.0 - momentum
    placed = df.withColumn("__r", (F.row_number().over(_order(seq, pos)) - 1).cast("long")).withColumn("__c", F.floor(F.col("__r") / chunk))
    packed = placed.groupBy(seq, "__c").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")))), lambda s: s["x"]).alias("x"))

    def fold(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) * keep + x)))

    own = packed.withColumn("own", F.slice(fold(F.transform("x", lambda x: x * momentum), F.lit(0.0)), 2, chunk))
    ends = own.select(seq, "__c", F.element_at("own", -1).alias("e"), F.pow(F.lit(keep), F.size("x")).alias("k"))
    chain = ends.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct("__c", "e", "k"))).alias("all"))
    steps = F.aggregate("all", F.array(F.lit(0.0)), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) * c["k"] + c["e"])))
    before = chain.select(F.col(seq).alias("__s"), F.posexplode(steps).alias("__b", "start"))
    whole = own.join(before, own[seq].eqNullSafe(before["__s"]) & (own["__c"] == before["__b"]))
    means = F.transform("own", lambda m, i: m + F.col("start") * F.pow(F.lit(keep), i + 1))
    rows = whole.select(F.col("__s"), F.col("__c").alias("__d"), F.posexplode(means).alias("__i", "mean")).withColumn("__q", F.col("__d") * chunk + F.col("__i"))
    return placed.join(rows, placed[seq].eqNullSafe(rows["__s"]) & (placed["__r"] == rows["__q"])).select(*[placed[c] for c in df.columns], "mean")
