"""Arrays that remember how they were made, and pass gradients back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which its array was stretched."""
    grad = grad.sum(axis=tuple(range(grad.ndim - len(shape)))) if grad.ndim > len(shape) else grad
    axes = tuple(i for i, n in enumerate(shape) if n == 1 and grad.shape[i] != 1)
    return grad.sum(axis=axes, keepdims=True) if axes else grad


class Tensor:
    """data, grad, and for results the tensors they come from with the function that gives each its gradient."""

    __array_ufunc__ = None  # numpy leaves operations with a tensor on the right to the tensor

    def __init__(self, data, requires_grad: bool = False, parents: Sequence[tuple[Tensor, Callable]] = (), op: str = ""):
        self.data = np.asarray(data, float)
        self.requires_grad = requires_grad or any(p.requires_grad for p, _ in parents)
        self.parents = [p for p in parents if p[0].requires_grad]
        self.grad: np.ndarray | None = None
        self.op = op

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape

    @property
    def ndim(self) -> int:
        return self.data.ndim

    @property
    def size(self) -> int:
        return self.data.size

    @property
    def T(self) -> Tensor:
        return self.transpose()

    @staticmethod
    def of(x) -> Tensor:
        return x if isinstance(x, Tensor) else Tensor(x)

    def __add__(self, other) -> Tensor:
        b = Tensor.of(other)
        return Tensor(self.data + b.data, parents=[(self, lambda g: _fit(g, self.shape)), (b, lambda g: _fit(g, b.shape))], op="+")

    def __mul__(self, other) -> Tensor:
        b = Tensor.of(other)
        return Tensor(self.data * b.data, parents=[(self, lambda g: _fit(g * b.data, self.shape)), (b, lambda g: _fit(g * self.data, b.shape))], op="*")

    def __pow__(self, p: float) -> Tensor:
        return Tensor(self.data**p, parents=[(self, lambda g: g * p * self.data ** (p - 1))], op="**")

    def __neg__(self) -> Tensor:
        return self * -1.0

    def __sub__(self, other) -> Tensor:
        return self + -Tensor.of(other)

    def __truediv__(self, other) -> Tensor:
        return self * Tensor.of(other) ** -1.0

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other) -> Tensor:
        return Tensor.of(other) - self

    def __rtruediv__(self, other) -> Tensor:
        return Tensor.of(other) / self

    def __abs__(self) -> Tensor:
        return Tensor(np.abs(self.data), parents=[(self, lambda g: g * np.sign(self.data))], op="abs")

    def __matmul__(self, other) -> Tensor:
        b = Tensor.of(other)
        return Tensor(self.data @ b.data, parents=[(self, lambda g: _fit(g @ np.swapaxes(b.data, -1, -2), self.shape)), (b, lambda g: _fit(np.swapaxes(self.data, -1, -2) @ g, b.shape))], op="@")

    matmul = __matmul__

    def __getitem__(self, index) -> Tensor:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.data)
            np.add.at(out, index, g)
            return out

        return Tensor(self.data[index], parents=[(self, back)], op="[]")

    def sum(self, axis=None, keepdims: bool = False) -> Tensor:
        def back(g: np.ndarray) -> np.ndarray:
            return np.broadcast_to(g if keepdims or axis is None else np.expand_dims(g, axis), self.shape).copy()

        return Tensor(self.data.sum(axis=axis, keepdims=keepdims), parents=[(self, back)], op="sum")

    def mean(self, axis=None, keepdims: bool = False) -> Tensor:
        total = self.sum(axis, keepdims)
        return total * (total.size / max(1, self.size))

    def reshape(self, shape: tuple[int, ...]) -> Tensor:
        return Tensor(self.data.reshape(shape), parents=[(self, lambda g: g.reshape(self.shape))], op="reshape")

    def transpose(self, axes: tuple[int, ...] | None = None) -> Tensor:
        return Tensor(self.data.transpose(axes), parents=[(self, lambda g: g.transpose(None if axes is None else np.argsort(axes)))], op="T")

    def log(self) -> Tensor:
        return Tensor(np.log(self.data + 1e-15), parents=[(self, lambda g: g / (self.data + 1e-15))], op="log")

    def exp(self) -> Tensor:
        out = np.exp(self.data)
        return Tensor(out, parents=[(self, lambda g: g * out)], op="exp")

    def apply(self, f: Callable, slope: Callable, op: str) -> Tensor:
        """An element-wise function with its derivative, both of the data."""
        return Tensor(f(self.data), parents=[(self, lambda g: g * slope(self.data))], op=op)

    def backward(self, gradient: np.ndarray | None = None) -> None:
        """Adds gradients to all tensors behind; a gradient must be given unless this is one number."""
        if gradient is None and self.size != 1:
            raise ValueError("a gradient is needed for more than one number")
        order, seen, work = [], set(), [(self, False)]
        while work:
            node, done = work.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                work.append((node, True))
                work += [(p, False) for p, _ in node.parents]
        grads = {id(self): np.ones(self.shape) if gradient is None else np.asarray(gradient, float)}
        for node in reversed(order):
            g = grads.pop(id(node))
            node.grad = g if node.grad is None else node.grad + g
            for parent, back in node.parents:
                own = back(g)
                grads[id(parent)] = grads[id(parent)] + own if id(parent) in grads else own

    def zero_grad(self) -> None:
        self.grad = None

    def detach(self) -> Tensor:
        return Tensor(self.data.copy())

    def numpy(self) -> np.ndarray:
        return self.data.copy()

    def item(self) -> float:
        if self.size != 1:
            raise ValueError("more than one number")
        return float(self.data.reshape(-1)[0])

    def graph(self) -> tuple[list[dict], list[tuple[int, int]]]:
        """Nodes (id, op, shape) and edges (from, to) of what this comes from."""
        nodes, edges, work, seen = [], [], [self], set()
        while work:
            node = work.pop()
            if id(node) in seen:
                continue
            seen.add(id(node))
            nodes.append({"id": id(node), "op": node.op, "shape": list(node.shape)})
            for parent, _ in node.parents:
                edges.append((id(parent), id(node)))
                work.append(parent)
        return nodes, edges


def concatenate(tensors: Sequence[Tensor], axis: int = 0) -> Tensor:
    ends = np.cumsum([t.shape[axis] for t in tensors])
    cut = lambda i: (lambda g: np.split(g, ends[:-1], axis=axis)[i])
    return Tensor(np.concatenate([t.data for t in tensors], axis=axis), parents=[(t, cut(i)) for i, t in enumerate(tensors)], op="concatenate")


def stack(tensors: Sequence[Tensor], axis: int = 0) -> Tensor:
    return concatenate([t.reshape((*t.shape[:axis], 1, *t.shape[axis:])) for t in tensors], axis)


def numerical_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    """Central differences."""
    out = np.zeros_like(x, dtype=float)
    for i in np.ndindex(x.shape):
        up, down = x.astype(float), x.astype(float)
        up[i] += h
        down[i] -= h
        out[i] = (f(up) - f(down)) / (2 * h)
    return out


def relu(x: Tensor) -> Tensor:
    return x.apply(lambda v: np.maximum(v, 0), lambda v: (v > 0).astype(float), "relu")


def leaky_relu(x: Tensor, slope: float = 0.01) -> Tensor:
    return x.apply(lambda v: np.where(v > 0, v, slope * v), lambda v: np.where(v > 0, 1.0, slope), "leaky_relu")


def sigmoid(x: Tensor) -> Tensor:
    f = lambda v: 1 / (1 + np.exp(-np.clip(v, -100, 100)))
    return x.apply(f, lambda v: f(v) * (1 - f(v)), "sigmoid")


def tanh(x: Tensor) -> Tensor:
    return x.apply(np.tanh, lambda v: 1 - np.tanh(v) ** 2, "tanh")


def gelu(x: Tensor) -> Tensor:
    return 0.5 * x * (1 + tanh((x + 0.044715 * x**3.0) * np.sqrt(2 / np.pi)))


def softmax(x: Tensor, axis: int = -1) -> Tensor:
    powers = (x - x.data.max(axis=axis, keepdims=True)).exp()
    return powers / powers.sum(axis=axis, keepdims=True)


def reduced(x: Tensor, how: str) -> Tensor:
    return {"mean": x.mean, "sum": x.sum, "none": lambda: x}[how]()


def mse_loss(p: Tensor, t, how: str = "mean") -> Tensor:
    return reduced((p - t) ** 2.0, how)


def mae_loss(p: Tensor, t, how: str = "mean") -> Tensor:
    return reduced(abs(p - t), how)


def huber_loss(p: Tensor, t, delta: float = 1.0, how: str = "mean") -> Tensor:
    d = p - t
    f = lambda v: np.where(np.abs(v) <= delta, 0.5 * v * v, delta * (np.abs(v) - 0.5 * delta))
    return reduced(d.apply(f, lambda v: np.clip(v, -delta, delta), "huber"), how)


def bce_loss(p: Tensor, t, how: str = "mean") -> Tensor:
    t = Tensor.of(t)
    return reduced(-(t * p.log() + (1 - t) * (1 - p).log()), how)


def cross_entropy_loss(logits: Tensor, labels: np.ndarray, how: str = "mean") -> Tensor:
    """labels: class numbers, or rows of shares."""
    shifted = logits - logits.data.max(axis=-1, keepdims=True)
    logs = shifted - shifted.exp().sum(axis=-1, keepdims=True).log()
    labels = np.asarray(labels)
    if labels.ndim == 1:
        return reduced(-logs[np.arange(len(labels)), labels.astype(int)], how)
    return reduced(-(logs * labels).sum(axis=-1), how)


def distillation_loss(student: Tensor, teacher: np.ndarray, labels: np.ndarray, temperature: float = 4.0, alpha: float = 0.5) -> Tensor:
    soft = softmax(Tensor(teacher) / temperature).data
    own = softmax(student / temperature)
    kl = (soft * (np.log(soft + 1e-15) - own.log())).sum(axis=-1).mean()
    return alpha * temperature**2 * kl + (1 - alpha) * cross_entropy_loss(student, labels)
