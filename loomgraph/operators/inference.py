"""Log-linear models over small discrete factor graphs: exact inference, likelihoods, optimisers, training.

A factor is a dict: vars (ids), sizes (of their domains), and per joint assignment, last variable fastest, either
`scores` (log weights) or `features` (lists of (weight index, value)). Inference works on forests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.kernels import per_object


def _lse(a: np.ndarray, axis=None) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    out = np.log(np.sum(np.exp(a - top), axis=axis, keepdims=True)) + top
    return out.squeeze() if axis is None else np.squeeze(out, axis=axis)


def tables(factors: list[dict], weights: np.ndarray | None = None) -> list[np.ndarray]:
    """Log weights of each factor's assignments, in the shape of its domains (ML7)."""
    flat = [f["scores"] if weights is None or f.get("features") is None else [sum(weights[int(i)] * v for i, v in one) for one in f["features"]] for f in factors]
    return [np.asarray(s, float).reshape([int(n) for n in f["sizes"]]) for s, f in zip(flat, factors)]


class Beliefs:
    """Messages up and down each tree of a factor graph (ML11). `best` takes maxima instead of sums."""

    def __init__(self, factors: list[dict], logs: list[np.ndarray], best: bool = False):
        self.factors, self.logs, self.best = factors, logs, best
        self.sizes = {v: int(n) for f in factors for v, n in zip(f["vars"], f["sizes"])}
        self.at: dict = {v: [] for v in self.sizes}
        for i, f in enumerate(factors):
            for v in f["vars"]:
                self.at[v].append(i)
        self.up: list[tuple] = []  # (factor, its variable nearer the root), children first
        self.roots, seen = [], set()
        for root in self.at:
            if root in seen:
                continue
            seen.add(root)
            self.roots.append(root)
            order, todo, used = [], [root], set()
            while todo:
                v = todo.pop()
                for i in self.at[v]:
                    if i in used:
                        continue
                    used.add(i)
                    order.append((i, v))
                    for u in self.factors[i]["vars"]:
                        if u != v:
                            if u in seen:
                                raise ValueError("the factor graph has a cycle")
                            seen.add(u)
                            todo.append(u)
            self.up += reversed(order)
        self.to_var: dict = {}
        for i, v in self.up:
            self.to_var[i, v] = self._message(i, v)
        self.log_z = float(sum(self._reduce(self._node(r)) for r in self.roots))

    def _reduce(self, a, axis=None):
        return np.max(a, axis=axis) if self.best else _lse(a, axis)

    def _node(self, v, but=None) -> np.ndarray:
        return sum((self.to_var[i, v] for i in self.at[v] if i != but), np.zeros(self.sizes[v]))

    def joint(self, i: int, but=None) -> np.ndarray:
        """A factor's table with all that reaches it, except from the variable `but`."""
        a = self.logs[i].copy()
        for k, u in enumerate(self.factors[i]["vars"]):
            if u != but:
                a = a + self._node(u, i).reshape([-1 if j == k else 1 for j in range(a.ndim)])
        return a

    def _message(self, i, v) -> np.ndarray:
        a = self.joint(i, v)
        rest = tuple(k for k, u in enumerate(self.factors[i]["vars"]) if u != v)
        return self._reduce(a, rest) if rest else a

    def down(self) -> None:
        for i, v in reversed(self.up):
            for u in self.factors[i]["vars"]:
                if u != v:
                    self.to_var[i, u] = self._message(i, u)

    def marginals(self) -> dict:
        """Log probabilities of each variable's values."""
        self.down()
        return {v: (lambda a: a - _lse(a))(self._node(v)) for v in self.at}

    def decode(self) -> dict:
        """A best assignment; ties go to the smaller value."""
        chosen: dict = {r: int(np.argmax(self._node(r))) for r in self.roots}
        for i, v in reversed(self.up):
            names = self.factors[i]["vars"]
            a = self.joint(i, v)[tuple(chosen[u] if u == v else slice(None) for u in names)]
            if a.ndim:
                chosen |= {u: int(x) for u, x in zip([u for u in names if u != v], np.unravel_index(np.argmax(a), a.shape))}
        return chosen


def brute_force(factors: list[dict], logs: list[np.ndarray]) -> dict[tuple, float]:
    """The log weight of every assignment of the sorted variables (ML12, ML13)."""
    sizes = {v: int(n) for f in factors for v, n in zip(f["vars"], f["sizes"])}
    names = sorted(sizes)
    out = {}
    for values in product(*[range(sizes[v]) for v in names]):
        at = dict(zip(names, values))
        out[values] = float(sum(t[tuple(at[v] for v in f["vars"])] for f, t in zip(factors, logs)))
    return out


def infer(factors: DataFrame, key: str) -> DataFrame:
    """Of each graph's variables the log probabilities, the best value, and log z (ML11). `factors`: key,
    vars array<int>, sizes array<int>, scores array<double>. A graph with a cycle is an error."""

    def one(rows: list[dict]):
        rows = sorted(rows, key=lambda r: ([int(v) for v in r["vars"]], list(r["scores"])))
        rows = [{**r, "vars": [int(v) for v in r["vars"]]} for r in rows]
        logs = tables(rows)
        sums = Beliefs(rows, logs)
        chosen = Beliefs(rows, logs, best=True).decode()
        for v, p in sorted(sums.marginals().items()):
            yield v, p.tolist(), chosen[v], sums.log_z

    return per_object(factors, key, one, "var int, log_prob array<double>, best int, log_z double")


def nll(factors: list[dict], gold: dict, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of an assignment and its gradient (ML14)."""
    logs = tables(factors, weights)
    b = Beliefs(factors, logs)
    b.down()
    loss, grad = b.log_z, np.zeros(len(weights))
    for i, (f, t) in enumerate(zip(factors, logs)):
        own = tuple(gold[v] for v in f["vars"])
        loss -= t[own]
        a = b.joint(i)
        p = np.exp(a - _lse(a)).ravel()
        p[np.ravel_multi_index(own, t.shape)] -= 1.0
        for share, one in zip(p, f["features"]):
            for k, value in one:
                grad[int(k)] += share * value
    return float(loss), grad


def numerical_gradient(fn: Callable[[np.ndarray], float], weights: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Central differences (ML17)."""
    steps = np.eye(len(weights)) * eps
    return np.array([(fn(weights + s) - fn(weights - s)) / (2 * eps) for s in steps])


@dataclass
class Sgd:
    """Gradient descent with weight decay and (Nesterov) momentum; plain where both are 0 (ML15)."""

    rate: float = 0.1
    momentum: float = 0.0
    nesterov: bool = False
    decay: float = 0.0
    state: Any = None

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * w
        if self.momentum:
            self.state = g if self.state is None else self.momentum * self.state + g
            g = g + self.momentum * self.state if self.nesterov else self.state
        return w - self.rate * g


@dataclass
class Adam:
    """Adam, with the largest second moment kept where `amsgrad` (ML15)."""

    rate: float = 0.05
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.0
    amsgrad: bool = False
    state: list = field(default_factory=list)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * w
        t, m, v, top = self.state or (0, np.zeros_like(w), np.zeros_like(w), np.zeros_like(w))
        t, m, v = t + 1, self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
        top = np.maximum(top, v)
        self.state = [t, m, v, top]
        second = (top if self.amsgrad else v) / (1 - self.beta2**t)
        return w - self.rate * (m / (1 - self.beta1**t)) / (np.sqrt(second) + self.eps)


@dataclass
class EarlyStop:
    """Stops when the least loss is `patience` rounds old; keeps its weights (ML16)."""

    patience: int = 5
    least: float = float("inf")
    weights: Any = None
    age: int = 0

    def stop(self, loss: float, weights: np.ndarray) -> bool:
        if loss < self.least:
            self.least, self.weights, self.age = loss, weights.copy(), 0
        else:
            self.age += 1
        return self.age >= self.patience


def loss_and_gradient(examples: DataFrame, fn: Callable[[dict, np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over all rows: each task sums its own, Spark sums those by weight index (ML14).
    What reaches the driver is as long as the weights, whatever the number of examples."""

    def partial(batches):
        total, n = np.zeros(len(weights) + 1), 0
        for batch in batches:
            for row in batch.to_dict("records"):
                loss, grad = fn(row, weights)
                total[0] += loss
                total[1:] += grad
                n += 1
        if n:
            yield pd.DataFrame({"i": np.arange(len(total) + 1), "x": np.append(total, n)})

    sums = {r["i"]: r["x"] for r in examples.mapInPandas(partial, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    if not sums:
        return 0.0, np.zeros(len(weights))
    flat = np.array([sums[i] for i in range(len(weights) + 2)])
    return float(flat[0] / flat[-1]), flat[1:-1] / flat[-1]


def train(examples: DataFrame, fn, weights: np.ndarray, optimiser: Sgd | Adam, rounds: int = 50, stop: EarlyStop | None = None) -> tuple[np.ndarray, list[float]]:
    """Full-batch descent; returns the best weights and the losses (ML18)."""
    stop, losses = stop or EarlyStop(), []
    for _ in range(rounds):
        loss, grad = loss_and_gradient(examples, fn, weights)
        losses.append(loss)
        if stop.stop(loss, weights):
            break
        weights = optimiser.step(weights, grad)
    return stop.weights, losses
