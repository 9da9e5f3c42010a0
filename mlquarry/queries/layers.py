"""Layers, cells, optimisers and explanations with weights that SQL can repeat, on embeddings as images, steps or numbers."""

from __future__ import annotations

import numpy as np
from ..neural import training
from ..neural.modules import AvgPool2D, BatchNorm1d, Conv2D, Dropout, Flatten, Function, GRUCell, Linear, LSTMCell, MaxPool2D, RNNCell, Sequential
from ..neural.tensor import Tensor, mse_loss
from .common import Registry, rounded
from .media import IMAGES, SIGNALS, _kernel, _listed, _pixels, signals
from .media import query as media_query

query = Registry()


def _layer(name: str, kernel, sql: str, shape=(8, 8), source=None, col: str = "image") -> None:
    """Registers a kernel with its SQL, as the pictures' kernels are."""
    _kernel(name, kernel, shape, **({"source": source} if source else {}), col=col, sql=sql)
    query.queries[name], query.sql[name] = media_query.queries.pop(name), media_query.sql.pop(name)


def _conv(x: np.ndarray) -> np.ndarray:
    layer = Conv2D(1, 2, 3, stride=2, padding=1)
    layer.weight.data = np.arange(18.0).reshape(9, 2) / 100 - 0.05
    layer.bias.data = np.array([1.0, -1.0])
    return layer(Tensor(x[None, None])).data


_weight = "((((dy + 1) * 3 + dx + 1) * 2 + c) / 100.0 - 0.05)"
_inside = "CASE WHEN 2 * r + dy BETWEEN 0 AND 7 AND 2 * k + dx BETWEEN 0 AND 7 THEN image[CAST((2 * r + dy) * 8 + 2 * k + dx + 1 AS BIGINT)] ELSE 0 END"
_layer(
    "conv2d", _conv,
    f"SELECT vec_id, c * 16 + r * 4 + k AS i, round(sum({_inside} * {_weight}) + 1 - 2 * c, 6) + 0.0 AS value FROM {IMAGES}, range(2) a(c), range(4) b(r), range(4) d(k), range(-1, 2) e(dy), range(-1, 2) f(dx) GROUP BY vec_id, c, r, k",
)
for _name, _pool, _sql in (("max_pool2d", MaxPool2D(2), "max"), ("avg_pool2d", AvgPool2D(2), "avg")):
    _layer(_name, lambda x, pool=_pool: pool(Tensor(x[None, None])).data, f"SELECT vec_id, (y // 2) * 4 + x // 2 AS i, round({_sql}(v), 6) + 0.0 AS value FROM {_pixels()} GROUP BY 1, 2")
_layer("batch_norm", lambda x: BatchNorm1d(8)(Tensor(x)).data, f"SELECT vec_id, i, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 6) + 0.0 AS value FROM {_pixels()} WINDOW w AS (PARTITION BY vec_id, x)")


def _eval_dropout(x: np.ndarray) -> np.ndarray:
    """Dropout does nothing outside training."""
    model = Sequential(Flatten(), Dropout(0.5), Linear(64, 2))
    layer = [m for _, m in model.children() if isinstance(m, Linear)][0]
    layer.weight.data, layer.bias.data = np.stack([np.arange(64.0), np.ones(64)], axis=1) / 1000, np.array([0.5, 0.0])
    model.eval()
    return model(Tensor(x[None])).data


_layer("sequential_eval", _eval_dropout, _listed(f"SELECT vec_id, [sum(v * i) / 1000 + 0.5, sum(v) / 1000] AS l FROM {_pixels()} GROUP BY 1", 2))


def _cell(kind, x: np.ndarray) -> np.ndarray:
    """The states of a cell with one unit over the eight rows of a picture."""
    cell = kind(8, 1)
    g = cell.gates
    cell.w.data = (np.arange(8.0)[:, None] + 1 + np.arange(g)[None]) / 20_000
    cell.u.data, cell.b.data = (np.arange(g)[None] + 1) / 10.0, (np.arange(g) - 1) / 10.0
    state, out = None, []
    for row in x:
        state = cell(Tensor(row[None]), state)
        out.append(state[0].data[0, 0])
    return np.array(out)


def _cell_sql(gates: int, keep: dict[str, str], h: str) -> str:
    """The same as a chain of steps: z0, z1 ... are the gates' inputs without the state, keep what else a step computes."""
    sums = ", ".join(f"sum(v * (x + 1 + {g})) / 20000 + ({g} - 1) / 10.0 AS z{g}" for g in range(gates))
    steps = [f"z AS (SELECT vec_id, y, {sums} FROM {_pixels()} GROUP BY 1, 2)", "s0 AS (SELECT vec_id, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c FROM embeddings)"]
    for t in range(8):
        inner = f"SELECT z.*, s.h AS p, s.c AS q FROM z JOIN s{t} s USING (vec_id) WHERE y = {t}"
        for name, expression in keep.items():
            inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
        steps.append(f"s{t + 1} AS (SELECT vec_id, {h} AS h, {'c' if 'c' in keep else '0.0'} AS c FROM ({inner}))")
    rows = " UNION ALL ".join(f"SELECT vec_id, {t}::BIGINT AS i, round(h, 6) + 0.0 AS value FROM s{t + 1}" for t in range(8))
    return f"WITH {', '.join(steps)} {rows}"


def _sigmoid(z: str) -> str:
    return f"(1 / (1 + exp(-({z}))))"


_layer("rnn_cell", lambda x: _cell(RNNCell, x), _cell_sql(1, {}, "tanh(z0 + 0.1 * p)"))
_layer("lstm_cell", lambda x: _cell(LSTMCell, x), _cell_sql(4, {"c": f"{_sigmoid('z0 + 0.1 * p')} * q + {_sigmoid('z1 + 0.2 * p')} * tanh(z3 + 0.4 * p)"}, f"{_sigmoid('z2 + 0.3 * p')} * tanh(c)"))
_layer("gru_cell", lambda x: _cell(GRUCell, x), _cell_sql(3, {"r": _sigmoid("z0 + 0.1 * p"), "u": _sigmoid("z1 + 0.2 * p")}, "(1 - u) * tanh(z2 + r * 0.3 * p) + u * p"))


def _descent(make, x: np.ndarray) -> np.ndarray:
    """A parameter from 0 towards the first value of a signal, five steps on the square of the distance."""
    p = Tensor(np.zeros(1), requires_grad=True)
    optimizer, out = make([p]), []
    for _ in range(5):
        optimizer.zero_grad()
        ((p - x[:1]) ** 2.0).sum().backward()
        optimizer.step()
        out.append(p.data[0])
    return np.array(out)


def _descent_sql(keep: dict[str, str], p: str) -> str:
    """keep: what the optimiser remembers, from its old values and the gradient g in step number t."""
    names = list(keep)
    steps = ["s0 AS (SELECT vec_id, x[1] AS x, 0.0::DOUBLE AS p" + "".join(f", 0.0::DOUBLE AS {n}" for n in names) + f" FROM {SIGNALS})"]
    for t in range(1, 6):
        kept = ", ".join(["vec_id", "x", "p", "g", *(f"{e} AS {n}" for n, e in keep.items())])
        steps.append(f"s{t} AS (SELECT vec_id, x, {p.replace('@', str(t))} AS p{''.join(f', {n}' for n in names)} FROM (SELECT {kept} FROM (SELECT *, 2 * (p - x) AS g FROM s{t - 1})))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT vec_id, {t - 1}::BIGINT AS i, round(p, 6) + 0.0 AS value FROM s{t}" for t in range(1, 6))


ADAM = {"m": "0.9 * m + 0.1 * g", "v": "0.999 * v + 0.001 * g * g"}
STEP = "(p - 0.1 * m / (1 - pow(0.9, @)) / (sqrt(v / (1 - pow(0.999, @))) + 1e-8))"
for _name, _make, _sql in (
    ("optimizer_sgd", lambda p: training.SGD(p, 0.1, momentum=0.9), _descent_sql({"m": "0.9 * m + g"}, "p - 0.1 * m")),
    ("optimizer_adam", lambda p: training.Adam(p, 0.1), _descent_sql(ADAM, STEP)),
    ("optimizer_adamw", lambda p: training.AdamW(p, 0.1, weight_decay=0.01), _descent_sql(ADAM, f"{STEP} * (1 - 0.1 * 0.01)")),
    ("optimizer_rmsprop", lambda p: training.RMSprop(p, 0.1), _descent_sql({"s": "0.99 * s + 0.01 * g * g"}, "p - 0.1 * g / (sqrt(s) + 1e-8)")),
):
    _layer(_name, lambda x, make=_make: _descent(make, x), _sql, None, signals, "x")


class _Cubes(Linear):
    """The sum of the cubes, whose gradients are known."""

    def __init__(self) -> None:
        super().__init__(1, 1)

    def forward(self, x: Tensor) -> Tensor:
        return (x * x * x).sum(axis=1, keepdims=True)


_mid = " + ".join(f"pow({k} + 0.5, 2)" for k in range(20))
_layer("integrated_gradients", lambda x: training.integrated_gradients(_Cubes(), x[None], steps=20), f"SELECT vec_id, i, round(pow(x[i + 1], 3) * 3 * ({_mid}) / 8000, 6) + 0.0 AS value FROM {SIGNALS}, range(64) t(i)", None, signals, "x")
_layer("fgsm_attack", lambda x: training.fgsm(_Cubes(), x[None], np.zeros((1, 1)), lambda p, y: mse_loss(p, y), 0.05, -1.0, 1.0), f"SELECT vec_id, i, round(greatest(least(x[i + 1] + 0.05 * sign(list_sum(list_transform(x, lambda v: v * v * v))) * sign(x[i + 1] * x[i + 1]), 1), -1), 6) + 0.0 AS value FROM {SIGNALS}, range(64) t(i)", None, signals, "x")
_layer(
    "pgd_attack", lambda x: training.pgd(_Cubes(), np.clip(x, -1, 1)[None], np.full((1, 1), -1e9), lambda p, y: mse_loss(p, y), 0.03, 0.02, 3, -1.0, 1.0, None),
    f"SELECT vec_id, i, round(greatest(least(greatest(least(x[i + 1], 1), -1) + CASE WHEN x[i + 1] = 0 THEN 0 ELSE 0.03 END, 1), -1), 6) + 0.0 AS value FROM {SIGNALS}, range(64) t(i)", None, signals, "x",
)

VECTOR = f"(SELECT vec_id, i, x[i + 1] AS v FROM {SIGNALS}, range(64) t(i))"


@query(
    "activation_statistics",
    f"WITH h AS (SELECT vec_id, unnest([sum(v * (i - 32)) / 100, sum(v) / 100 + 1]) AS x FROM {VECTOR} GROUP BY 1), l AS (SELECT 0 AS layer, x FROM h UNION ALL SELECT 1, greatest(x, 0) FROM h) SELECT layer, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM l GROUP BY 1",
)
def activation_statistics(spark, sf_dir):
    model = Sequential(Linear(64, 2), Function("relu"))
    layer = next(iter(model.children()))[1]
    layer.weight.data, layer.bias.data = np.stack([np.arange(64.0) - 32, np.ones(64)], axis=1) / 100, np.array([0.0, 1.0])
    rows = signals(spark, sf_dir).withColumnRenamed("x", "v")
    return rounded(training.activation_statistics(rows, model), "mean", "std", "min", "max")


QUERIES, ORACLE_SQL = query.queries, query.sql
