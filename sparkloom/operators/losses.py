"""Losses of predictions against truth, and scoring of many programs in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.program import Node, project


def levenshtein(pred: Column, truth: Column) -> Column:
    """Edit distance; 1000 where there is no prediction."""
    return F.coalesce(F.levenshtein(pred, truth).cast("double"), F.lit(1000.0))


def absolute(pred: Column, truth: Column) -> Column:
    """Difference of values rounded to 12 digits, half to even; NULL for NaN."""
    d = F.abs(F.bround(pred.cast("double"), 12) - F.bround(truth.cast("double"), 12))
    return F.when(~F.isnan(d), d)


def absolute_sum(pred: Column, truth: Column) -> Column:
    """Sum over two lists of the differences that are numbers; 10000 if none is."""
    parts = F.filter(F.zip_with(pred, truth, absolute), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)).otherwise(10000.0)


def vector(pred: Column, truth: Column) -> Column:
    """1000 for each value by which lengths differ, and the differences of the common part."""
    n = F.least(F.size(pred), F.size(truth))
    near = F.zip_with(F.slice(pred, F.lit(1), n), F.slice(truth, F.lit(1), n), lambda p, t: F.abs(p - t).cast("double"))
    return F.abs(F.size(pred) - F.size(truth)) * 1000.0 + F.aggregate(near, F.lit(0.0), lambda s, x: s + x)


def score(samples: DataFrame, programs: Sequence[Node], truth: str, loss: Callable[[Column, Column], Column] = absolute, width: int = 50) -> list[float | None]:
    """Mean loss of each program over all samples: one job for ``width`` programs at a time; equal programs are evaluated once."""
    distinct = list(dict.fromkeys(programs))
    found: dict[Node, float | None] = {}
    for at in range(0, len(distinct), width):
        part = distinct[at : at + width]
        out = project(samples, {f"__p{i}": p for i, p in enumerate(part)})
        row = out.agg(*[F.avg(loss(F.col(f"__p{i}"), F.col(truth))).alias(f"l{i}") for i in range(len(part))]).first()
        found |= {p: row[i] for i, p in enumerate(part)}
    return [found[p] for p in programs]


def levenshtein_many(preds: Sequence[Column], truths: Sequence[Column]) -> Column:
    """Over several outputs: the sum of the edit distances, and 1000 more for a wrong number of outputs."""
    wrong = F.lit(1000.0 if len(preds) != len(truths) else 0.0)
    return sum((levenshtein(p, t) for p, t in zip(preds, truths, strict=False)), wrong)


def absolute_many(preds: Sequence[Column], truths: Sequence[Column]) -> Column:
    """The sum of the differences that are numbers, 10000 if none is; truths beyond the outputs are an error."""
    if len(preds) < len(truths):
        raise ValueError(f"{len(preds)} outputs for {len(truths)} values")
    return absolute_sum(F.array(*[p.cast("double") for p in preds[: len(truths)]]), F.array(*[t.cast("double") for t in truths]))


def vector_many(preds: Sequence[Column], truths: Sequence[Column]) -> Column:
    """Over several lists: the sum of their vector losses, values rounded to 12 digits; a list with NaN counts nothing."""
    if len(preds) < len(truths):
        raise ValueError(f"{len(preds)} outputs for {len(truths)} lists")
    rounded = lambda v: F.transform(v, lambda x: F.bround(x.cast("double"), 12))
    parts = [vector(rounded(p), rounded(t)) for p, t in zip(preds, truths, strict=False)]
    return sum((F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) for x in parts), F.lit(0.0))


def score_many(samples: DataFrame, programs: Sequence[Sequence[Node]], truths: Sequence[str], loss: Callable[[Sequence[Column], Sequence[Column]], Column], width: int = 50) -> list[float | None]:
    """Mean loss of programs of several outputs each, as score(): one job for ``width`` programs at a time."""
    found: list[float | None] = []
    for at in range(0, len(programs), width):
        part = programs[at : at + width]
        out = project(samples, {f"__p{i}_{k}": node for i, outputs in enumerate(part) for k, node in enumerate(outputs)})
        means = [F.avg(loss([F.col(f"__p{i}_{k}") for k in range(len(outputs))], [F.col(t) for t in truths])).alias(f"l{i}") for i, outputs in enumerate(part)]
        found += list(out.agg(*means).first())
    return found


def score_batches(samples: DataFrame, programs: Sequence[Node], truth: str, loss: Callable[[Column, Column], Column] = absolute, batch: str = "batch") -> list[dict[int, float | None]]:
    """For each program its mean loss in every batch of the samples, all in one job; a program's loss is the mean over its batches."""
    out = project(samples, {f"__p{i}": p for i, p in enumerate(programs)})
    rows = out.groupBy(batch).agg(*[F.avg(loss(F.col(f"__p{i}"), F.col(truth))).alias(f"l{i}") for i in range(len(programs))]).collect()
    return [{r[batch]: r[f"l{i}"] for r in rows} for i in range(len(programs))]
