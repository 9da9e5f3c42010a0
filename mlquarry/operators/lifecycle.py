"""Operations on tables of parameters, logits and genes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activations import softmax
from ..functions.arrays import total
from .neighbors import cosine


def fedavg(updates: DataFrame) -> DataFrame:
    """(param, idx, value): means over clients of (client_id, param, idx, delta, n), weighted by their n rows."""
    return updates.groupBy("param", "idx").agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("value"))


def clipped(updates: DataFrame, max_norm: float = 1.0, sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """Each client's parameter tensor scaled to a norm of max_norm at most, plus seeded Gaussian noise of sigma * max_norm."""
    norm = F.sqrt(F.sum(F.col("delta") * F.col("delta")).over(Window.partitionBy("client_id", "param")))
    out = updates.withColumn("delta", F.col("delta") / F.greatest(norm / max_norm, F.lit(1.0)))
    if not sigma:
        return out
    u = [(F.pmod(F.xxhash64(F.lit(seed + k), "client_id", "param", "idx"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1) for k in (0, 1)]
    noise = F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * 3.141592653589793 * u[1])
    return out.withColumn("delta", F.col("delta") + sigma * max_norm * noise)


def noise_scale(epsilon: float, delta: float = 1e-5) -> float:
    """Standard deviation of the Gaussian mechanism for a norm of 1."""
    from math import log, sqrt

    return sqrt(2 * log(1.25 / delta)) / epsilon


def quantized(params: DataFrame, group: list[str], value: str = "value", bits: int = 8, symmetric: bool = False) -> DataFrame:
    """params with scale, zero, q and the value that q stands for; one scale for each group. Rounding is half to even."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    top = float(2 ** (bits - 1) - 1)
    if symmetric:
        scale, zero = F.greatest(F.abs(low), F.abs(high)) / top, F.lit(0.0)
    else:
        scale = (high - low) / float(2**bits - 1)
        zero = -low / F.when(scale == 0, F.lit(1.0)).otherwise(scale) - top - 1
    scale = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    q = F.greatest(F.least(F.rint(F.col(value) / scale + zero), F.lit(top)), F.lit(-top - 1)).cast("int")
    return params.withColumns({"scale": scale, "zero": zero, "q": q, "restored": (q - zero) * scale})


def pruned(params: DataFrame, group: list[str], value: str = "value", sparsity: float = 0.5) -> DataFrame:
    """params with value 0 but for the max(1, n * (1 - sparsity)) largest of each group; ties with the last kept are kept."""
    n = F.count("*").over(Window.partitionBy(*group))
    rank = F.rank().over(Window.partitionBy(*group).orderBy(F.desc(F.abs(value))))
    return params.withColumn("__r", rank).withColumn("__n", n).withColumn(value, F.when(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * (1 - sparsity))), F.col(value)).otherwise(F.lit(0.0))).drop("__r", "__n")


def ensemble(predictions: DataFrame, row_id: str, value: str) -> DataFrame:
    """(row, mean, variance) over models or passes, population variance."""
    return predictions.groupBy(row_id).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def entropy(probabilities: Column) -> Column:
    return -total(F.transform(probabilities, lambda p: p * F.ln(p + 1e-10)))


def zero_shot(items: DataFrame, classes: list[tuple[str, list[float]]], vector: str = "v") -> DataFrame:
    """items with the class of largest cosine and the softmax over all of them; ties go to the first class."""
    if not classes:
        return items.withColumns({"probability": F.lit(None).cast("array<double>"), "prediction": F.lit(None).cast("string")})
    scores = F.array(*[cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in v])) for _, v in classes])
    names = F.array(*[F.lit(n) for n, _ in classes])
    return items.withColumn("probability", softmax(scores)).withColumn("prediction", F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int")))


def contrastive_losses(pairs: DataFrame, batch: str, key: str, a: str, b: str, temperature: float = 0.07, limit: int = 4096) -> DataFrame:
    """(batch, loss): of each batch the symmetric cross entropy of the cosines of all a with all b, the own pair being right.

    A batch of contrastive training is small by nature and is one group; more than limit rows in one raise ValueError.
    """
    kind = pairs.schema[batch].dataType.simpleString()

    def loss(z: np.ndarray) -> float:
        most = z.max(axis=1, keepdims=True)
        return float(np.mean(most[:, 0] + np.log(np.exp(z - most).sum(axis=1)) - np.diag(z)))

    def of_batch(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > limit:
            raise ValueError(f"a batch of more than {limit} rows")
        frame = frame.sort_values(key)
        x, y = (np.array(frame[c].tolist(), float) for c in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        z = x @ y.T / temperature
        return pd.DataFrame({"batch": [name[0]], "loss": [(loss(z) + loss(z.T)) / 2]})

    return pairs.groupBy(batch).applyInPandas(of_batch, f"batch {kind}, loss double")


def genome_distance(one: DataFrame, two: DataFrame, c1: float = 1.0, c2: float = 1.0, c3: float = 0.4) -> DataFrame:
    """One row: the compatibility distance of two tables (innovation, weight): c1 excess / n + c2 disjoint / n + c3 times the
    mean weight difference of matching genes; n is the larger size, infinity if nothing matches."""
    a, b = one.select("innovation", F.col("weight").alias("x")), two.select("innovation", F.col("weight").alias("y"))
    tops = a.agg(F.max("innovation")).first()[0], b.agg(F.max("innovation")).first()[0]
    edge = min(t if t is not None else -1 for t in tops)
    both = a.join(b, "innovation", "full_outer")
    single = F.isnull("x") | F.isnull("y")
    counts = both.agg(
        F.count_if(single & (F.col("innovation") > edge)).alias("excess"),
        F.count_if(single & (F.col("innovation") <= edge)).alias("disjoint"),
        F.count_if(~single).alias("matching"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean"),
        F.greatest(F.count("x"), F.count("y"), F.lit(1)).alias("n"),
    )
    value = (c1 * F.col("excess") + c2 * F.col("disjoint")) / F.col("n") + c3 * F.col("mean")
    return counts.select(F.when(F.col("matching") == 0, F.lit(float("inf"))).otherwise(value).alias("distance"))


def adjusted_fitness(genomes: DataFrame, species: str = "species_id", fitness: str = "fitness") -> DataFrame:
    return genomes.withColumn("adjusted", F.col(fitness) / F.count("*").over(Window.partitionBy(species)))


def culled(genomes: DataFrame, species: str = "species_id", fitness: str = "fitness", genome: str = "genome_id", survival: float = 0.2) -> DataFrame:
    """The max(2, n * survival) fittest genomes of each species; species of two or fewer stay."""
    n = F.count("*").over(Window.partitionBy(species))
    rank = F.row_number().over(Window.partitionBy(species).orderBy(F.desc(fitness), genome))
    kept = genomes.withColumn("__n", n).withColumn("__r", rank)
    return kept.where((F.col("__n") <= 2) | (F.col("__r") <= F.greatest(F.lit(2), F.floor(F.col("__n") * survival)))).drop("__n", "__r")


def gradient_diagnostics(steps: DataFrame, layer: str = "layer", mean_abs: str = "mean_abs", norm: str = "norm", vanish: float = 1e-6, explode: float = 1e3) -> DataFrame:
    """(layer, mean_norm, max_norm, n_vanishing, n_exploding) over recorded steps."""
    return steps.groupBy(layer).agg(F.avg(norm).alias("mean_norm"), F.max(norm).alias("max_norm"), F.count_if(F.col(mean_abs) < vanish).alias("n_vanishing"), F.count_if(F.col(norm) > explode).alias("n_exploding"))
