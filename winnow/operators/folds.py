"""Leave-one-group-out evaluation with a model fitted for each fold, all folds in one job for each step (R7 with M3, A20, A23).

A row trains most folds, so it is read once for all of them: a task multiplies its rows with the weights of all folds and
adds up each fold's gradient; the sums by fold and coordinate are one aggregation. The driver moves the weights of all folds at
once by limited-memory quasi-Newton steps; it holds numbers for folds x coordinates, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.operators.bootstrap import intervals
from winnow.operators.sampling import leave_one_group_out
from winnow.session import saved

#: Folds times coordinates that the driver and each task hold, a few MB for each of the HISTORY steps.
MOST_WEIGHTS, HISTORY = 2_000_000, 8


def _direction(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction of one fold from its last steps and changes of gradient."""
    d, stack = -g, []
    for s, y in reversed(steps):
        a = s @ d / (s @ y)
        d = d - a * y
        stack.append(a)
    if steps:
        s, y = steps[-1]
        d = d * (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(stack), strict=True):
        d = d + s * (a - y @ d / (s @ y))
    return d


def minimised(value_and_gradient, start: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """Rows of `start` that minimise functions of their own; value_and_gradient gives all of them at once.

    A row whose step doesn't lower its value enough is tried with half of it, while others go on.
    """
    x = start.copy()
    f, g = value_and_gradient(x)
    history = [[] for _ in x]
    d, t = -g / np.maximum(1.0, np.linalg.norm(g, axis=1, keepdims=True)), np.ones(len(x))
    for _ in range(iterations):
        going = np.linalg.norm(g, axis=1) > tolerance * np.maximum(1.0, np.linalg.norm(x, axis=1))
        if not going.any():
            break
        tried = np.where(going[:, None], x + t[:, None] * d, x)
        f_new, g_new = value_and_gradient(tried)
        for i in np.flatnonzero(going):
            if f_new[i] > f[i] + 1e-4 * t[i] * (g[i] @ d[i]) and t[i] > 1e-10:
                t[i] /= 2
                continue
            s, y = tried[i] - x[i], g_new[i] - g[i]
            if s @ y > 1e-12 * (y @ y):
                history[i] = [*history[i], (s, y)][-HISTORY:]
            x[i], f[i], g[i], t[i] = tried[i], f_new[i], g_new[i], 1.0
            d[i] = _direction(g[i], history[i])
    return x


@dataclass
class FoldModels:
    """A balanced L2 logistic regression for each fold: names and weights, the last one the intercept."""

    names: list
    weights: np.ndarray

    def scores(self, rows: DataFrame, folds: DataFrame) -> DataFrame:
        """(fold, id, y, score) of the rows (id, embedding, y) in the folds (fold, id) that have a model."""
        place, weights, kind = {n: i for i, n in enumerate(self.names)}, self.weights, folds.schema["fold"].dataType.simpleString()

        def score(batches):
            for pdf in batches:
                pdf = pdf[pdf["fold"].isin(place)]
                w = weights[[place[n] for n in pdf["fold"]]]
                x = np.array([*pdf["embedding"]], float).reshape(len(pdf), weights.shape[1] - 1)
                z = (x * w[:, :-1]).sum(1) + w[:, -1]
                yield pdf[["fold", "id", "y"]].assign(score=0.5 * (1 + np.tanh(z / 2)))

        met = folds.select("fold", "id").join(rows.where("embedding is not null").select("id", "embedding", "y"), "id").select("fold", "id", "y", "embedding")
        return met.mapInPandas(score, f"fold {kind}, id {rows.schema['id'].dataType.simpleString()}, y int, score double")


def fit_folds(rows: DataFrame, folds: DataFrame, c: float = 1.0, iterations: int = 300, tolerance: float = 1e-5) -> FoldModels:
    """A model for each fold of (fold, id) over its rows (id, embedding, y): classes weigh alike, the penalty is |w|^2 / 2 over
    c times the sum of losses, without the intercept. A fold with rows of one class only has no model."""
    known = rows.where("embedding is not null and y is not null").select("id", "embedding", F.col("y").cast("int").alias("y"))
    met = folds.select("fold", "id").join(known.select("id", "y"), "id")
    counts = {(r.fold, r.y): r.n for r in met.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    names = sorted({f for f, _ in counts if all(counts.get((f, y)) for y in (0, 1))})
    width = known.select(F.size("embedding")).first()
    if not names or width is None:
        return FoldModels([], np.zeros((0, 1)))
    width = width[0]
    if len(names) * (width + 1) > MOST_WEIGHTS:
        raise ValueError(f"{len(names)} folds of {width + 1} weights are more than MOST_WEIGHTS; fit some of them at a time")
    per_class = np.array([[(counts[f, 0] + counts[f, 1]) / (2 * counts[f, y]) for y in (0, 1)] for f in names])
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    of_row = met.where(F.col("fold").isin(names)).groupBy("id").agg(F.collect_set(index[F.col("fold")]).alias("folds"))  # one for each fold at most
    data = saved(known.join(of_row, "id").select("embedding", "y", "folds"), "fold-rows")

    def value_and_gradient(w: np.ndarray):
        def partial(batches):
            total = np.zeros((len(names), width + 2))
            for pdf in batches:
                x = np.column_stack([np.array([*pdf["embedding"]], float), np.ones(len(pdf))])
                y = pdf["y"].to_numpy()
                held = np.zeros((len(pdf), len(names)))
                for i, f in enumerate(pdf["folds"]):
                    held[i, f] = 1
                held *= per_class.T[y]
                z = x @ w.T
                total[:, -1] += (held * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
                total[:, :-1] += (held * (0.5 * (1 + np.tanh(z / 2)) - y[:, None])).T @ x
            fold, at = np.indices(total.shape)
            yield pd.DataFrame({"fold": fold.ravel(), "at": at.ravel(), "value": total.ravel()})

        out = np.zeros((len(names), width + 2))
        for r in data.mapInPandas(partial, "fold int, at int, value double").groupBy("fold", "at").agg(F.sum("value").alias("value")).collect():
            out[r.fold, r.at] = r.value
        penalty = np.column_stack([w[:, :-1], np.zeros(len(w))])
        return c * out[:, -1] + (penalty**2).sum(1) / 2, c * out[:, :-1] + penalty

    return FoldModels(names, minimised(value_and_gradient, np.zeros((len(names), width + 1)), iterations, tolerance))


def leave_one_out_rows(rows: DataFrame, group: str, iterations: int = CONFIG.iterations, roles: tuple[str, ...] = ("train",), **options) -> DataFrame:
    """(fold, n_pos, n_neg, auroc, auroc_lo, auroc_hi, detection_rate) of each group of positives held out in turn.

    rows (id, embedding, y, group). Folds, their sampled negatives and the groups without one are those of
    leave_one_group_out(), whose other options go through; a fold whose test or training rows have one class has no row. detection_rate is
    the share of held-out positives that score the threshold or more.
    """
    # vectors that a model makes would be made again for each of the passes below
    rows = saved(rows.select("id", "embedding", "y", group), "fold-vectors")
    folds = saved(leave_one_group_out(rows, "id", "y", group, **options), "folds")
    models = fit_folds(rows, folds.where(F.col("role").isin(*roles)))
    scored = saved(models.scores(rows, folds.where("role = 'test'")).select(F.col("fold").alias("split"), F.lit("linear").alias("method"), "id", "y", "score"), "fold-scores")
    counts = scored.groupBy("split").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"), F.avg(F.when(F.col("y") == 1, (F.col("score") >= CONFIG.threshold).cast("double"))).alias("detection_rate"))
    found = intervals(scored, iterations).select("split", "auroc", "auroc_lo", "auroc_hi")
    return counts.where("n_pos > 0 and n_neg > 0").join(found, "split").select(F.col("split").alias("fold"), "n_pos", "n_neg", "auroc", "auroc_lo", "auroc_hi", "detection_rate")
