"""Layers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .tensor import Tensor, concatenate, gelu, leaky_relu, relu, sigmoid, softmax, stack, tanh


class Module:
    """Parameters and inner modules are what attributes hold, in order of their names."""

    training = True

    def __call__(self, *args, **kwargs):
        return self.forward(*args, **kwargs)

    def forward(self, *args, **kwargs) -> Tensor:
        raise NotImplementedError

    def children(self) -> list[tuple[str, Module]]:
        out = []
        for k, v in sorted(vars(self).items()):
            for i, m in enumerate(v if isinstance(v, list | tuple) else [v]):
                if isinstance(m, Module):
                    out.append((f"{k}.{i}" if isinstance(v, list | tuple) else k, m))
        return out

    def named_parameters(self) -> list[tuple[str, Tensor]]:
        own = [(k, v) for k, v in sorted(vars(self).items()) if isinstance(v, Tensor) and v.requires_grad]
        return own + [(f"{n}.{k}", p) for n, m in self.children() for k, p in m.named_parameters()]

    def parameters(self) -> list[Tensor]:
        return [p for _, p in self.named_parameters()]

    def zero_grad(self) -> None:
        for p in self.parameters():
            p.zero_grad()

    def train(self, mode: bool = True) -> Module:
        self.training = mode
        for _, m in self.children():
            m.train(mode)
        return self

    def eval(self) -> Module:
        return self.train(False)


class Sequential(Module):
    def __init__(self, *modules: Module):
        self.layers = list(modules)

    def forward(self, x: Tensor) -> Tensor:
        for m in self.layers:
            x = m(x)
        return x


class Function(Module):
    """An activation as a layer."""

    KINDS = {"relu": relu, "leaky_relu": leaky_relu, "sigmoid": sigmoid, "tanh": tanh, "gelu": gelu, "softmax": softmax}

    def __init__(self, name: str, *args):
        if name not in self.KINDS:
            raise ValueError(f"unknown activation {name!r}")
        self.name, self.args = name, args

    def forward(self, x: Tensor) -> Tensor:
        return self.KINDS[self.name](x, *self.args)


def _uniform(random: np.random.Generator, shape: tuple[int, ...], limit: float) -> Tensor:
    return Tensor(random.uniform(-limit, limit, shape), requires_grad=True)


class Linear(Module):
    def __init__(self, n_in: int, n_out: int, bias: bool = True, init_method: str = "xavier", seed: int = 0):
        random = np.random.default_rng(seed)
        if init_method == "xavier":
            self.weight = _uniform(random, (n_in, n_out), np.sqrt(6 / (n_in + n_out)))
        else:
            self.weight = Tensor(random.normal(0, np.sqrt(2 / n_in) if init_method == "he" else 0.01, (n_in, n_out)), requires_grad=True)
        self.bias = Tensor(np.zeros(n_out), requires_grad=True) if bias else None

    def forward(self, x: Tensor) -> Tensor:
        out = x @ self.weight
        return out + self.bias if self.bias is not None else out


class Dropout(Module):
    def __init__(self, p: float = 0.5, seed: int = 0):
        if not 0 <= p < 1:
            raise ValueError("p must be from 0 to below 1")
        self.p, self.random = p, np.random.default_rng(seed)

    def forward(self, x: Tensor) -> Tensor:
        return x * ((self.random.random(x.shape) >= self.p) / (1 - self.p)) if self.training and self.p else x


class Flatten(Module):
    def __init__(self, start_dim: int = 1):
        self.start = start_dim

    def forward(self, x: Tensor) -> Tensor:
        return x.reshape((*x.shape[: self.start], -1))


class BatchNorm1d(Module):
    def __init__(self, n: int, eps: float = 1e-5, momentum: float = 0.1):
        self.gamma, self.beta = Tensor(np.ones(n), requires_grad=True), Tensor(np.zeros(n), requires_grad=True)
        self.mean, self.var, self.eps, self.momentum = np.zeros(n), np.ones(n), eps, momentum

    def forward(self, x: Tensor) -> Tensor:
        if self.training:
            mean = x.mean(axis=0, keepdims=True)
            var = ((x - mean) ** 2.0).mean(axis=0, keepdims=True)
            m = self.momentum
            self.mean, self.var = (1 - m) * self.mean + m * mean.data[0], (1 - m) * self.var + m * var.data[0]
        else:
            mean, var = Tensor(self.mean), Tensor(self.var)
        return (x - mean) / (var + self.eps) ** 0.5 * self.gamma + self.beta


def patches(x: Tensor, k: int, stride: int, padding: int, fill: float = 0.0) -> tuple[Tensor, int, int]:
    """All k * k patches of (n, c, h, w) as (n, rows, columns, c, k, k), with the rows and columns there are."""
    n, c, h, w = x.shape
    padded = np.pad(x.data, ((0, 0), (0, 0), (padding, padding), (padding, padding)), constant_values=fill)
    view = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(2, 3))[:, :, ::stride, ::stride]
    rows, columns = view.shape[2:4]

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(padded)
        g = g.transpose(0, 3, 1, 2, 4, 5)
        for i in range(k):
            for j in range(k):
                out[:, :, i : i + stride * rows : stride, j : j + stride * columns : stride] += g[..., i, j]
        return out[:, :, padding : padding + h, padding : padding + w]

    return Tensor(view.transpose(0, 2, 3, 1, 4, 5).copy(), parents=[(x, back)], op="patches"), rows, columns


class Conv2D(Module):
    def __init__(self, n_in: int, n_out: int, kernel_size: int, stride: int = 1, padding: int = 0, bias: bool = True, seed: int = 0):
        size = n_in * kernel_size**2
        self.weight = Tensor(np.random.default_rng(seed).normal(0, np.sqrt(2 / size), (size, n_out)), requires_grad=True)
        self.bias = Tensor(np.zeros(n_out), requires_grad=True) if bias else None
        self.k, self.stride, self.padding = kernel_size, stride, padding

    def forward(self, x: Tensor) -> Tensor:
        p, rows, columns = patches(x, self.k, self.stride, self.padding)
        out = p.reshape((x.shape[0], rows, columns, -1)) @ self.weight
        out = out + self.bias if self.bias is not None else out
        return out.transpose((0, 3, 1, 2))


class MaxPool2D(Module):
    def __init__(self, kernel_size: int, stride: int | None = None, padding: int = 0):
        self.k, self.stride, self.padding = kernel_size, stride or kernel_size, padding

    def forward(self, x: Tensor) -> Tensor:
        p, rows, columns = patches(x, self.k, self.stride, self.padding, -np.inf)
        flat = p.reshape((x.shape[0], rows, columns, x.shape[1], -1))
        at = flat.data.argmax(axis=-1)
        return flat[(*np.ogrid[tuple(slice(n) for n in at.shape)], at)].transpose((0, 3, 1, 2))


class AvgPool2D(MaxPool2D):
    def forward(self, x: Tensor) -> Tensor:
        p, _, _ = patches(x, self.k, self.stride, self.padding)
        return p.mean(axis=(4, 5)).transpose((0, 3, 1, 2))


class RNNCell(Module):
    gates = 1

    def __init__(self, n_in: int, n_hidden: int, seed: int = 0):
        random, limit = np.random.default_rng(seed), 1 / np.sqrt(n_hidden)
        self.w = _uniform(random, (n_in, self.gates * n_hidden), limit)
        self.u = _uniform(random, (n_hidden, self.gates * n_hidden), limit)
        self.b = Tensor(np.zeros(self.gates * n_hidden), requires_grad=True)
        self.n = n_hidden

    def start(self, rows: int) -> tuple[Tensor, ...]:
        return (Tensor(np.zeros((rows, self.n))),)

    def gate(self, x: Tensor, i: int) -> Tensor:
        return x[:, i * self.n : (i + 1) * self.n]

    def forward(self, x: Tensor, state: tuple[Tensor, ...] | None = None) -> tuple[Tensor, ...]:
        (h,) = state or self.start(x.shape[0])
        return (tanh(x @ self.w + h @ self.u + self.b),)


class LSTMCell(RNNCell):
    """Gates in the order forget, input, output, candidate."""

    gates = 4

    def start(self, rows: int) -> tuple[Tensor, ...]:
        return Tensor(np.zeros((rows, self.n))), Tensor(np.zeros((rows, self.n)))

    def forward(self, x: Tensor, state: tuple[Tensor, ...] | None = None) -> tuple[Tensor, ...]:
        h, c = state or self.start(x.shape[0])
        z = x @ self.w + h @ self.u + self.b
        f, i, o = (sigmoid(self.gate(z, k)) for k in range(3))
        c = f * c + i * tanh(self.gate(z, 3))
        return o * tanh(c), c


class GRUCell(RNNCell):
    """Gates in the order reset, update, new."""

    gates = 3

    def forward(self, x: Tensor, state: tuple[Tensor, ...] | None = None) -> tuple[Tensor, ...]:
        (h,) = state or self.start(x.shape[0])
        a, b = x @ self.w + self.b, h @ self.u
        r, z = (sigmoid(self.gate(a, k) + self.gate(b, k)) for k in range(2))
        return ((1 - z) * tanh(self.gate(a, 2) + r * self.gate(b, 2)) + z * h,)


class RNN(Module):
    """Layers of cells over (time, rows, features), or (rows, time, features) if batch_first; gives all steps' outputs."""

    CELLS = {"rnn": RNNCell, "lstm": LSTMCell, "gru": GRUCell}

    def __init__(self, n_in: int, n_hidden: int, num_layers: int = 1, cell_type: str = "rnn", batch_first: bool = False, seed: int = 0):
        if cell_type not in self.CELLS:
            raise ValueError(f"unknown cell {cell_type!r}")
        self.cells = [self.CELLS[cell_type](n_in if i == 0 else n_hidden, n_hidden, seed + i) for i in range(num_layers)]
        self.batch_first = batch_first

    def forward(self, x: Tensor) -> Tensor:
        steps = [x[:, t] if self.batch_first else x[t] for t in range(x.shape[1 if self.batch_first else 0])]
        for cell in self.cells:
            state, out = cell.start(steps[0].shape[0]), []
            for s in steps:
                state = cell(s, state)
                out.append(state[0])
            steps = out
        return stack(steps, 1 if self.batch_first else 0)


class CrossAttention(Module):
    """Rows of a attend to rows of b; a, what it found, joined and projected."""

    def __init__(self, dim_a: int, dim_b: int, hidden: int = 256, seed: int = 0):
        self.q, self.k, self.v = Linear(dim_a, hidden, seed=seed), Linear(dim_b, hidden, seed=seed + 1), Linear(dim_b, hidden, seed=seed + 2)
        self.out = Linear(dim_a + hidden, hidden, seed=seed + 3)
        self.scale = np.sqrt(hidden)

    def forward(self, a: Tensor, b: Tensor) -> Tensor:
        found = softmax(self.q(a) @ self.k(b).T / self.scale) @ self.v(b)
        return self.out(concatenate([a, found], axis=1))


def mlp(sizes: Sequence[int], activation: str = "relu", dropout: float = 0.0, seed: int = 0) -> Sequential:
    layers: list[Module] = []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        layers.append(Linear(a, b, init_method="he" if activation == "relu" else "xavier", seed=seed + i))
        if i < len(sizes) - 2:
            layers.append(Function(activation))
            if dropout:
                layers.append(Dropout(dropout, seed + i))
    return Sequential(*layers)


#: Models by name.
ZOO = {"mlp_mnist": lambda: mlp([784, 256, 128, 10], dropout=0.2), "mlp_tiny": lambda: mlp([2, 8, 1]), "mlp_deep": lambda: mlp([512, 256, 128, 64, 10])}
