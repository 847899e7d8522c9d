"""Constants of programs, fitted by covariance matrix adaptation: a candidate is a row of constants, and all candidates are scored in one job."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import losses
from .program import Call, Constant, Input, Node, Sharing, project, steps


class Cma:
    """An evolution strategy whose steps follow a covariance learned from the better half of each generation."""

    def __init__(self, start: Sequence[float], sigma: float = 0.5, size: int | None = None, seed: int = 0):
        self.mean, self.sigma, self.rng = np.array(start, float), float(sigma), np.random.default_rng(seed)
        n = self.n = len(self.mean)
        if n < 1:
            raise ValueError("there is no constant to fit")
        self.size = size or 4 + int(3 * np.log(n))
        if self.size < 2:
            raise ValueError("a generation has at least two candidates")
        half = self.size // 2
        raw = np.log((self.size + 1) / 2) - np.log(np.arange(1, half + 1))
        self.weights = raw / raw.sum()
        m = self.effective = 1 / (self.weights**2).sum()
        self.rate_step, self.rate_path = (m + 2) / (n + m + 5), (4 + m / n) / (n + 4 + 2 * m / n)
        self.rate_one = 2 / ((n + 1.3) ** 2 + m)
        self.rate_many = min(1 - self.rate_one, 2 * (m - 2 + 1 / m) / ((n + 2) ** 2 + m))
        self.damping = 1 + 2 * max(0.0, np.sqrt((m - 1) / (n + 1)) - 1) + self.rate_step
        self.length = np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
        self.cov, self.step, self.path, self.generation = np.eye(n), np.zeros(n), np.zeros(n), 0

    def ask(self) -> np.ndarray:
        """The next candidates, one a row."""
        scale, axes = np.linalg.eigh(self.cov)
        self.scale, self.axes = np.sqrt(np.maximum(scale, 1e-20)), axes
        return self.mean + self.sigma * (self.rng.standard_normal((self.size, self.n)) * self.scale) @ self.axes.T

    def tell(self, candidates: np.ndarray, values: Sequence[float]) -> None:
        """Learn from the losses of the candidates that were asked for."""
        self.generation += 1
        order = np.argsort(np.asarray(values, float), kind="stable")[: len(self.weights)]
        moves = (candidates[order] - self.mean) / self.sigma
        move = self.weights @ moves
        self.mean = self.mean + self.sigma * move
        white = self.axes @ ((self.axes.T @ move) / self.scale)
        self.step = (1 - self.rate_step) * self.step + np.sqrt(self.rate_step * (2 - self.rate_step) * self.effective) * white
        size = np.linalg.norm(self.step)
        still = size / np.sqrt(1 - (1 - self.rate_step) ** (2 * self.generation)) < (1.4 + 2 / (self.n + 1)) * self.length
        self.path = (1 - self.rate_path) * self.path + still * np.sqrt(self.rate_path * (2 - self.rate_path) * self.effective) * move
        lost = (1 - still) * self.rate_one * self.rate_path * (2 - self.rate_path)
        self.cov = (1 - self.rate_one - self.rate_many + lost) * self.cov + self.rate_one * np.outer(self.path, self.path) + self.rate_many * (moves.T * self.weights) @ moves
        self.cov = (self.cov + self.cov.T) / 2
        self.sigma *= float(np.exp(min(1.0, (size / self.length - 1) * self.rate_step / self.damping)))


def free_constants(outputs: Sequence[Node], prefix: str = "k") -> tuple[list[Node], dict[str, float]]:
    """The programs with inputs k1, k2, ... for their distinct float constants, and the constants' values by these names."""
    names: dict[str, float] = {}
    known: dict[float, str] = {}

    def leaf(n: Node) -> Node:
        if not isinstance(n, Constant) or n.type != "float":
            return n
        if n.value not in known:
            known[n.value] = f"{prefix}{len(known) + 1}"
            names[known[n.value]] = float(n.value)
        return Input(known[n.value], "float")

    return Sharing().rebuild(outputs, leaf=leaf), names


def bind_constants(outputs: Sequence[Node], values: dict[str, float]) -> list[Node]:
    """The programs with constants in place of the inputs of these names."""
    return Sharing().rebuild(outputs, leaf=lambda n: Constant(values[n.column], "float") if isinstance(n, Input) and n.column in values else n)


def random_constants(program: Node, how_many: int, rng: random.Random, prefix: str = "k") -> tuple[Node, dict[str, float]]:
    """The program with up to ``how_many`` of its float inputs' places, drawn among its calls' arguments, taken by new constants between 0 and 1."""
    if how_many < 1:
        raise ValueError("at least one constant")
    program = Sharing().rebuild([program])[0]
    places = [(id(c), k) for c in steps([program]) for k, a in enumerate(c.args) if isinstance(a, Input) and a.type == "float"]
    names = {place: f"{prefix}{n}" for n, place in enumerate(rng.sample(places, min(how_many, len(places))), 1)}
    made: dict[int, Node] = {}
    for c in steps([program]):
        made[id(c)] = Call(c.op, tuple(Input(names[id(c), k], "float") if (id(c), k) in names else made.get(id(a), a) for k, a in enumerate(c.args)), c.type)
    return made.get(id(program), program), {n: rng.random() for n in names.values()}


def score_candidates(samples: DataFrame, program: Node, names: Sequence[str], candidates: np.ndarray, truth: str, loss: Callable = losses.absolute) -> list[float]:
    """Mean loss of the program under each row of constants, in one job.

    Each task meets its samples with the candidates, a literal of a few numbers each, and adds up losses by candidate before
    the shuffle, so that a row for each candidate and task is all that moves. NULL and NaN means count as infinite.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(n) for n, v in zip(names, c, strict=True)]) for i, c in enumerate(candidates)])
    kept = [c for c in samples.columns if c not in names]
    met = samples.select(*[f"`{c}`" for c in kept], F.explode(rows).alias("__c")).select(*[f"`{c}`" for c in kept], F.col("__c.i").alias("__i"), *[F.col(f"__c.{n}").alias(n) for n in names])
    means = project(met, {"__p": program}).groupBy("__i").agg(F.avg(loss(F.col("__p"), F.col(truth))).alias("m")).collect()
    found = {r["__i"]: r["m"] for r in means}
    return [float("inf") if (x := found.get(i)) is None or x != x else x for i in range(len(candidates))]


@dataclass
class Fit:
    """values by name, their loss, the best loss of each generation."""

    values: dict[str, float]
    loss: float = float("inf")
    history: list[float] = field(default_factory=list)


def fit_constants(samples: DataFrame, program: Node, start: dict[str, float], truth: str, loss: Callable = losses.absolute, generations: int = 60, sigma: float = 0.5, size: int | None = None, close: float = 1e-12, seed: int = 0) -> Fit:
    """Fit the float inputs named in ``start`` to the samples; the best candidate of all generations is kept."""
    names = list(start)
    cma, out, held = Cma([start[n] for n in names], sigma, size, seed), Fit(dict(start)), samples.cache()
    try:
        for _ in range(generations):
            candidates = cma.ask()
            values = score_candidates(held, program, names, candidates, truth, loss)
            best = int(np.argmin(values))
            if values[best] < out.loss:
                out.values, out.loss = dict(zip(names, candidates[best].tolist(), strict=True)), values[best]
            out.history.append(out.loss)
            if out.loss <= close:
                break
            cma.tell(candidates, values)
    finally:
        held.unpersist()
    return out
