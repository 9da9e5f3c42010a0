"""Named steps over a frame, and plans given as lists of operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Pipeline:
    """Steps (name, operator with fit and transform) applied in order. A step is fitted on the frame that the steps before
    give, lazily: fitting reads the source once a step and writes nothing."""

    def __init__(self, steps: Sequence[tuple[str, object]]):
        names = [n for n, _ in steps]
        if not names or len(set(names)) < len(names):
            raise ValueError("steps must be there and have different names")
        self.steps = list(steps)

    def fit(self, df: DataFrame) -> Pipeline:
        self.fit_transform(df)
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.fit(df).transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def get_params(self) -> dict[str, object]:
        """step__name to value, for the plain attributes of all steps."""
        return {f"{n}__{k}": v for n, s in self.steps for k, v in vars(s).items() if not k.startswith("_") and not isinstance(v, DataFrame)}


#: Operations on a text column, by the name that a plan uses.
TEXT: dict[str, Callable[..., Column]] = {
    "clean": T.clean,
    "normalize": T.normalize,
    "tokenize": T.tokenize,
    "ngrams": T.ngrams,
    "stopwords": T.remove_stopwords,
    "simple_stem": lambda tokens: F.transform(tokens, T.simple_stem),
    "lancaster_stem": lambda tokens: F.transform(tokens, T.lancaster_stem),
}


class TextPlan:
    """A plan such as [{"operation": "clean", "params": {...}}, {"operation": "tokenize"}], compiled to one projection."""

    def __init__(self, plan: Sequence[dict]):
        unknown = [s["operation"] for s in plan if s["operation"] not in TEXT]
        if unknown:
            raise ValueError(f"unknown operations {unknown}")
        self.plan, self.history = list(plan), [s["operation"] for s in plan]

    def column(self, value: Column) -> Column:
        for step in self.plan:
            value = TEXT[step["operation"]](value, **step.get("params", {}))
        return value

    def apply(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or col, self.column(F.col(col)))


class Graph:
    """A DAG of named transforms: each node is a function of the frames of its inputs."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {}

    def add_node(self, name: str, function: Callable[..., DataFrame], inputs: Sequence[str]) -> None:
        if name in self.nodes:
            raise ValueError(f"node {name!r} is there already")
        self.nodes[name] = (function, list(inputs))

    def order(self) -> list[str]:
        """Nodes after all their inputs; RuntimeError for a cycle."""
        done: list[str] = []
        left = dict(self.nodes)
        while left:
            ready = sorted(n for n, (_, inputs) in left.items() if not any(i in left for i in inputs))
            if not ready:
                raise RuntimeError("the graph has a cycle")
            done += ready
            for n in ready:
                del left[n]
        return done

    def run(self, frames: dict[str, DataFrame], output: str) -> DataFrame:
        found = dict(frames)
        for name in self.order():
            function, inputs = self.nodes[name]
            found[name] = function(*[found[i] for i in inputs])
        return found[output]
