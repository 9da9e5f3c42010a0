"""Optimisers, and training over DataFrames: tasks add up the gradients of their rows, the driver takes the step."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighbors import _vectors
from .modules import Dropout, Linear, Module
from .tensor import Tensor, cross_entropy_loss


class Optimizer:
    """Subclasses turn a gradient into a change, with what they keep for each parameter."""

    def __init__(self, parameters: list[Tensor], lr: float = 0.01, weight_decay: float = 0.0):
        self.parameters, self.lr, self.decay, self.t = list(parameters), lr, weight_decay, 0
        self.kept = [{} for _ in self.parameters]

    def change(self, g: np.ndarray, kept: dict) -> np.ndarray:
        raise NotImplementedError

    def step(self) -> None:
        self.t += 1
        for p, kept in zip(self.parameters, self.kept, strict=True):
            if p.grad is not None:
                p.data = p.data - self.lr * self.change(p.grad + self.decay * p.data, kept)

    def zero_grad(self) -> None:
        for p in self.parameters:
            p.grad = None


class SGD(Optimizer):
    def __init__(self, parameters: list[Tensor], lr: float = 0.01, momentum: float = 0.0, weight_decay: float = 0.0):
        super().__init__(parameters, lr, weight_decay)
        self.momentum = momentum

    def change(self, g: np.ndarray, kept: dict) -> np.ndarray:
        kept["v"] = self.momentum * kept.get("v", 0.0) + g
        return kept["v"]


class Adam(Optimizer):
    def __init__(self, parameters: list[Tensor], lr: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.0):
        super().__init__(parameters, lr, weight_decay)
        self.betas, self.eps = betas, eps

    def change(self, g: np.ndarray, kept: dict) -> np.ndarray:
        a, b = self.betas
        kept["m"] = a * kept.get("m", 0.0) + (1 - a) * g
        kept["v"] = b * kept.get("v", 0.0) + (1 - b) * g * g
        return kept["m"] / (1 - a**self.t) / (np.sqrt(kept["v"] / (1 - b**self.t)) + self.eps)


class AdamW(Adam):
    """Weights shrink after the step, apart from the gradient."""

    def __init__(self, parameters: list[Tensor], lr: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.01):
        super().__init__(parameters, lr, betas, eps, 0.0)
        self.shrink = weight_decay

    def step(self) -> None:
        super().step()
        for p in self.parameters:
            p.data = p.data * (1 - self.lr * self.shrink)


class RMSprop(Optimizer):
    def __init__(self, parameters: list[Tensor], lr: float = 0.01, alpha: float = 0.99, eps: float = 1e-8, momentum: float = 0.0, weight_decay: float = 0.0):
        super().__init__(parameters, lr, weight_decay)
        self.alpha, self.eps, self.momentum = alpha, eps, momentum

    def change(self, g: np.ndarray, kept: dict) -> np.ndarray:
        kept["s"] = self.alpha * kept.get("s", 0.0) + (1 - self.alpha) * g * g
        d = g / (np.sqrt(kept["s"]) + self.eps)
        kept["b"] = self.momentum * kept.get("b", 0.0) + d
        return kept["b"] if self.momentum else d


Loss = Callable[[Tensor, np.ndarray], Tensor]


class Trainer:
    """A model, an optimiser over its parameters, and a loss that sums over rows ("sum" reduction).

    A step's gradient is the sum over its rows, divided by their number: tasks run the model over BATCH rows at a time and
    add up gradients, which are as large as the parameters whatever the rows; PARTS tasks add those up again.
    """

    BATCH, PARTS = 1024, 16
    SUMS = "part int, loss double, n long, g binary"

    def __init__(self, model: Module, optimizer: Optimizer, loss: Loss):
        self.model, self.optimizer, self.loss = model, optimizer, loss
        self.history: list[dict] = []

    def _sums(self, df: DataFrame, target: str, grads: bool) -> tuple[float, int, list[np.ndarray]]:
        model, loss, size, parts, names = self.model, self.loss, self.BATCH, self.PARTS, ["part", "loss", "n", "g"]
        for p in model.parameters():
            p.grad = None
        sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

        def sums(part: int, total: float, n: int, g: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.float64()), pa.array([n], pa.int64()), pa.array([g], pa.binary())], names=names)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total, n = pickle.loads(sent.value), 0.0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    value = loss(own(Tensor(_vectors(part.column(0)))), part.column(1).to_numpy(zero_copy_only=False))
                    total, n = total + value.item(), n + part.num_rows
                    if grads:
                        value.backward()
            flat = [np.zeros(p.shape) if p.grad is None else p.grad for p in own.parameters()] if grads and n else []
            if n:
                yield sums(TaskContext.get().partitionId() % parts, total, n, np.concatenate([g.reshape(-1) for g in flat]).tobytes() if flat else b"")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, found = 0.0, 0, None
            for batch in batches:
                for _, own, rows, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total, n = total + own, n + rows
                    if g:
                        found = np.frombuffer(g) + (0.0 if found is None else found)
            if n:
                yield sums(0, total, n, b"" if found is None else found.tobytes())

        each = df.select("v", F.col(target)).mapInArrow(kernel, self.SUMS)
        rows = sorted(each.repartition(parts, "part").mapInArrow(add, self.SUMS).collect(), key=lambda r: (r.n, r.loss))  # at most PARTS rows
        total, n = sum(r.loss for r in rows), sum(r.n for r in rows)
        found = sum(np.frombuffer(bytes(r.g)) for r in rows) if rows and grads else None
        out, at = [], 0
        for p in model.parameters() if found is not None else []:
            out.append(found[at : at + p.size].reshape(p.shape) / max(1, n))
            at += p.size
        return total, n, out

    def _step(self, df: DataFrame, target: str) -> tuple[float, int]:
        total, n, grads = self._sums(df, target, True)
        if n:
            for p, g in zip(self.model.parameters(), grads, strict=True):
                p.grad = g
            self.optimizer.step()
            self.optimizer.zero_grad()
        return total, n

    def fit(self, train: DataFrame, target: str, epochs: int = 10, validation: DataFrame | None = None, patience: int | None = None, batch_size: int | None = None) -> list[dict]:
        """Trains and returns the history. Without batch_size an epoch is one step over all rows; with it rows fall into
        batches of about that size by a hash of themselves and the epoch, and each batch is a step. patience: epochs
        without a better (validation) loss after which the best parameters are taken back."""
        best, waited, kept = np.inf, 0, None
        batches = max(1, round(train.count() / batch_size)) if batch_size else 1
        for epoch in range(len(self.history), len(self.history) + epochs):
            self.model.train()
            if batches == 1:
                done = [self._step(train, target)]
            else:
                at = F.pmod(F.xxhash64("v", F.col(target), F.lit(epoch)), F.lit(batches))
                done = [self._step(train.where(at == k), target) for k in range(batches)]
            row = {"epoch": epoch, "loss": sum(t for t, _ in done) / max(1, sum(n for _, n in done))}
            if validation is not None:
                row["val_loss"] = self.evaluate(validation, target)
            self.history.append(row)
            value = row.get("val_loss", row["loss"])
            if value < best:
                best, waited, kept = value, 0, [p.data.copy() for p in self.model.parameters()]
            else:
                waited += 1
                if patience is not None and waited >= patience:
                    for p, d in zip(self.model.parameters(), kept, strict=True):
                        p.data = d
                    break
        self.model.eval()
        return self.history

    def evaluate(self, df: DataFrame, target: str) -> float:
        """The mean loss over df, without dropout."""
        self.model.eval()
        total, n, _ = self._sums(df, target, False)
        return total / max(1, n)

    def save_checkpoint(self, path: str) -> None:
        """Parameters, state of the optimiser and history, as one file."""
        state = {"parameters": [p.data for p in self.model.parameters()], "kept": self.optimizer.kept, "t": self.optimizer.t, "history": self.history}
        with open(path, "wb") as file:
            np.savez(file, state=np.frombuffer(pickle.dumps(state), np.uint8))

    def load_checkpoint(self, path: str) -> None:
        """Goes on where save_checkpoint() was; only for files of one's own, since they are unpickled."""
        with np.load(path) as file:
            state = pickle.loads(file["state"].tobytes())
        for p, d in zip(self.model.parameters(), state["parameters"], strict=True):
            p.data = d
        self.optimizer.kept, self.optimizer.t, self.history = state["kept"], state["t"], state["history"]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with output: an array of the model's values."""
        return forward(df, self.model)


def forward(df: DataFrame, model: Module, name: str = "output") -> DataFrame:
    """df (features in v) with the model's output as an array of doubles."""
    sent, at = df.sparkSession.sparkContext.broadcast(pickle.dumps(model)), df.columns.index("v")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            out = own(Tensor(_vectors(batch.column(at)))).data.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float64()))], names=[*batch.schema.names, name])

    return df.mapInArrow(kernel, df.select(*df.columns, F.lit(None).cast("array<double>").alias(name)).schema)


def activation_statistics(df: DataFrame, model: Module) -> DataFrame:
    """(layer, n, mean, std, min, max) of what each layer of a sequence gives for the rows of df (features in v), layers
    numbered from 0; the whole tables of activations never leave the tasks."""
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = [m for _, m in pickle.loads(sent.value).children()]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = Tensor(_vectors(batch.column(0))), []
            for i, layer in enumerate(layers):
                x = layer(x)
                rows.append((i, x.data.size, x.data.sum(), (x.data**2).sum(), x.data.min(), x.data.max()))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["layer", "n", "s", "q", "low", "high"])

    parts = df.select("v").mapInArrow(kernel, "layer int, n long, s double, q double, low double, high double")
    mean = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0)))
    return parts.groupBy("layer").agg(F.sum("n").alias("n"), mean.alias("mean"), spread.alias("std"), F.min("low").alias("min"), F.max("high").alias("max"))


class ContrastiveLearner(Module):
    """Two encoders with a projection each; forward(x, y) is the symmetric cross entropy of the cosines of a batch's pairs."""

    def __init__(self, encoder_a: Module, encoder_b: Module, n_a: int, n_b: int, dim: int = 128, temperature: float = 0.07, seed: int = 0):
        self.encoder_a, self.encoder_b, self.temperature = encoder_a, encoder_b, temperature
        self.project_a, self.project_b = Linear(n_a, dim, seed=seed), Linear(n_b, dim, seed=seed + 1)

    def embed(self, x: Tensor, side: str = "a") -> Tensor:
        """Projected vectors of length one."""
        out = self.project_a(self.encoder_a(x)) if side == "a" else self.project_b(self.encoder_b(x))
        return out / ((out**2.0).sum(axis=1, keepdims=True) + 1e-24) ** 0.5

    def forward(self, x: Tensor, y: Tensor) -> Tensor:
        z = self.embed(x, "a") @ self.embed(y, "b").T * (1 / self.temperature)
        own = np.arange(x.shape[0])
        return (cross_entropy_loss(z, own) + cross_entropy_loss(z.T, own)) * 0.5


def mc_dropout(df: DataFrame, id_col: str, model: Module, n_samples: int = 30) -> DataFrame:
    """(id, mean, variance) of the first output over passes with dropout on, each pass with a seed of its own in each task;
    one scan for all passes. A repeated id has its rows' passes together."""

    def seeded(m: Module, seed: int) -> None:
        for _, child in m.children():
            if isinstance(child, Dropout):
                child.random = np.random.default_rng(seed)
            seeded(child, seed + 1)

    model.train()
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    model.eval()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [pickle.loads(sent.value) for _ in range(n_samples)]
        for k, own in enumerate(passes):
            seeded(own, 1000 * k)
        for batch in batches:
            if batch.num_rows:
                x = Tensor(_vectors(batch.column(1)))
                y = np.stack([own(x).data.reshape(batch.num_rows, -1)[:, 0] for own in passes])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y.sum(axis=0)), pa.array((y * y).sum(axis=0))], names=[id_col, "s", "q"])

    kind = df.schema[id_col].dataType.simpleString()
    sums = df.select(id_col, "v").mapInArrow(kernel, f"`{id_col}` {kind}, s double, q double").groupBy(id_col).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("n"))
    mean = F.col("s") / (F.col("n") * n_samples)
    return sums.select(id_col, mean.alias("mean"), F.greatest(F.col("q") / (F.col("n") * n_samples) - mean * mean, F.lit(0.0)).alias("variance"))


def integrated_gradients(model: Module, x: np.ndarray, target: int | None = None, baseline: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """(x - baseline) times the mean gradient of the target output along the way."""
    base = np.zeros_like(x, dtype=float) if baseline is None else baseline
    total = np.zeros_like(x, dtype=float)
    for k in range(steps):
        at = Tensor(base + (k + 0.5) / steps * (x - base), requires_grad=True)
        out = model(at)
        (out if target is None else out[:, target]).sum().backward()
        total += at.grad
    return (x - base) * total / steps


def fgsm(model: Module, x: np.ndarray, y: np.ndarray, loss: Loss, epsilon: float = 0.03, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    at = Tensor(x, requires_grad=True)
    loss(model(at), y).backward()
    return np.clip(x + epsilon * np.sign(at.grad), low, high)


def pgd(model: Module, x: np.ndarray, y: np.ndarray, loss: Loss, epsilon: float = 0.03, step: float = 0.007, rounds: int = 10, low: float = 0.0, high: float = 1.0, seed: int | None = 0) -> np.ndarray:
    out = x if seed is None else np.clip(x + np.random.default_rng(seed).uniform(-epsilon, epsilon, x.shape), low, high)
    for _ in range(rounds):
        out = np.clip(np.clip(fgsm(model, out, y, loss, step, low, high), x - epsilon, x + epsilon), low, high)
    return out


def federated_round(clients: DataFrame, client_id: str, target: str, model: Module, loss: Loss, lr: float = 0.01, local_epochs: int = 5) -> DataFrame:
    """(client_id, param, idx, delta, n): each client's change of the parameters after training on its own rows.

    A client's rows are one group of a task, as a client's data is by nature; lifecycle.fedavg averages the changes.
    """
    state = pickle.dumps(model)
    kind = clients.schema[client_id].dataType.simpleString()

    def local(key, frame):
        import pandas as pd

        own = pickle.loads(state)
        before = [p.data.copy() for p in own.parameters()]
        optimizer, x, y = SGD(own.parameters(), lr), np.array(frame["v"].tolist(), float), frame[target].to_numpy()
        for _ in range(local_epochs):
            optimizer.zero_grad()
            (loss(own(Tensor(x)), y) * (1 / len(x))).backward()
            optimizer.step()
        rows = [(key[0], i, j, float(d), len(x)) for i, (p, b) in enumerate(zip(own.parameters(), before, strict=True)) for j, d in enumerate((p.data - b).reshape(-1))]
        return pd.DataFrame(rows, columns=["client_id", "param", "idx", "delta", "n"])

    return clients.select(client_id, "v", target).groupBy(client_id).applyInPandas(local, f"client_id {kind}, param int, idx int, delta double, n long")


def updated(model: Module, averages: DataFrame) -> None:
    """Adds averaged changes (param, idx, value) to the model's parameters."""
    for row in averages.toLocalIterator():
        model.parameters()[row.param].data.reshape(-1)[row.idx] += row["value"]
