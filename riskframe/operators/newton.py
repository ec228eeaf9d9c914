"""Many penalised logistic regressions fitted together by Newton steps.

The problems of a grid search differ in the rows they leave out (a fold) and in
the strength of the penalty, not in the table.  Each round is one aggregate over
the rows: every task adds, for all unfinished problems, loss, gradient and
Hessian of its rows by matrix products; a sum by problem and position gives the
totals, a bounded table of numbers (problems x columns^2), from which the next
steps are solved.  So a search costs as many jobs as Newton needs rounds, however
many problems it has.  A step that does not lower the loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import through_files

TOLERANCE = 1e-9           # of each entry of the gradient of the mean loss
ROUNDS = 200


@dataclass
class Problem:
    """Mean logistic loss + |w|^2 / (2 C n) over the rows outside fold ``left_out`` (None: all rows)."""

    left_out: int | None
    C: float
    weights: np.ndarray | None = None        # one a feature, the intercept last
    rows: int = 0

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights[:-1]

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])


def _sums(weights: np.ndarray, left_out: np.ndarray, names: list[str]):
    """Loss, rows, gradient and Hessian of each problem over a task's rows."""
    d = len(names) + 1
    a, b = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), 2 + d + len(a)))
        for batch in batches:
            x = np.column_stack([*[batch.column(n).to_numpy(zero_copy_only=False) for n in names], np.ones(batch.num_rows)])
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            z = x @ weights.T
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            used = (fold[:, None] != left_out[None, :]).astype(np.float64)
            loss = (np.logaddexp(0.0, z) - y[:, None] * z) * used
            total[:, 0] += loss.sum(0)
            total[:, 1] += used.sum(0)
            total[:, 2:2 + d] += ((p - y[:, None]) * used).T @ x
            for i, s in enumerate((p * (1 - p) * used).T):
                total[i, 2 + d:] += (x.T @ (x * s[:, None]))[a, b]
        i, at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, at, total)], names=["problem", "at", "value"])

    return run


def fit_all(rows: DataFrame, names: list[str], problems: list[Problem], label: str = "y", fold: str = "fold",
            tolerance: float = TOLERANCE) -> tuple[list[Problem], int]:
    """The problems with their weights, and the rounds it took.  Each round reads ``rows`` once."""
    data = rows.select(*[F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)],
                       F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    cols, d = [f"x{i}" for i in range(len(names))], len(names) + 1
    a, b = np.triu_indices(d)
    now = [np.zeros(d) for _ in problems]
    best = [(np.inf, w) for w in now]
    open_, rounds = list(range(len(problems))), 0
    while open_:
        if rounds == ROUNDS:
            raise RuntimeError(f"{len(open_)} regressions are not finished after {ROUNDS} rounds")
        rounds += 1
        left = np.array([-1 if problems[i].left_out is None else problems[i].left_out for i in open_])
        run = _sums(np.array([now[i] for i in open_]), left, cols)
        found = data.mapInArrow(run, "problem long, at long, value double").groupBy("problem", "at").agg(F.sum("value").alias("value")).toPandas()
        total = np.zeros((len(open_), 2 + d + len(a)))
        total[found["problem"].to_numpy(), found["at"].to_numpy()] = found["value"].to_numpy()
        still = []
        for i, t in zip(open_, total, strict=True):
            w, n = now[i], t[1]
            problems[i].rows = int(n)
            if not n:
                problems[i].weights = w
                continue
            keep = np.append(w[:-1], 0.0) / (problems[i].C * n)          # the intercept isn't penalised
            loss = t[0] / n + 0.5 * float(keep @ w)
            if loss > best[i][0] + 1e-13 * abs(best[i][0]):
                now[i] = (w + best[i][1]) / 2.0
                still.append(i)
                continue
            gradient = t[2:2 + d] / n + keep
            problems[i].weights = w
            if np.abs(gradient).max() < tolerance:
                continue
            hessian = np.zeros((d, d))
            hessian[a, b] = hessian[b, a] = t[2 + d:] / n
            hessian[np.arange(d - 1), np.arange(d - 1)] += 1.0 / (problems[i].C * n)
            best[i] = (loss, w)
            now[i] = w - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            still.append(i)
        open_ = still
    return problems, rounds


def held_out_scores(rows: DataFrame, names: list[str], problems: list[Problem], label: str = "y", fold: str = "fold") -> DataFrame:
    """(fold, C, y, p) of every row under each problem that left its fold out."""
    data = rows.select(*[F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)],
                       F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"))
    cols = [f"x{i}" for i in range(len(names))]
    some = [p for p in problems if p.left_out is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in cols])
            y, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for p in some:
                mine = at == p.left_out
                z = x[mine] @ p.coefficients + p.intercept
                yield pa.RecordBatch.from_arrays([pa.array(at[mine].astype(np.int32)), pa.array(np.full(int(mine.sum()), p.C)), pa.array(y[mine].astype(np.int32)),
                                                  pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))], names=["fold", "C", "y", "p"])

    return data.mapInArrow(run, "fold int, C double, y int, p double")


def largest_slopes(rows: DataFrame, names: list[str], problems: list[Problem], label: str = "y", fold: str = "fold") -> DataFrame:
    """(problem, left_out, C, n, slope): the largest entry of each problem's gradient at its weights, by column expressions.

    ``problem`` is its place in the list.  One aggregate a problem, in one job: its weights are literals, so
    a row is neither copied a problem nor grouped by weights."""
    told = []
    for i, p in enumerate(problems):
        part = rows if p.left_out is None else rows.where(F.col(fold) != p.left_out)
        x = [F.col(f"`{n}`").cast("double") for n in names]
        z = sum((F.lit(float(w)) * c for w, c in zip(p.coefficients, x, strict=True)), F.lit(p.intercept))
        part = part.select(*[c.alias(f"x{j}") for j, c in enumerate(x)], (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col(label)).alias("r"))
        sums = part.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("r") * F.col(f"x{j}")).alias(f"g{j}") for j in range(len(names))], F.avg("r").alias("last"))
        slopes = [F.abs(F.col(f"g{j}") + F.lit(float(w)) / (F.lit(p.C) * F.col("n"))) for j, w in enumerate(p.coefficients)]
        told.append(sums.where("n > 0").select(F.lit(i).alias("problem"), F.lit(p.left_out).cast("int").alias("left_out"), F.lit(p.C).alias("C"), "n",
                                               F.array_max(F.array(*slopes, F.abs("last"))).alias("slope")))
    return reduce(DataFrame.unionByName, told)


@dataclass
class Grid:
    """A grid search: mean held-out AUC of each C, every fit, and the one of the best C on all rows.

    ``aucs`` holds (fold, C, AUC) of every fit that left a fold out."""

    means: dict[float, float]
    fits: list[Problem]
    scores: DataFrame
    best: Problem
    rounds: int
    aucs: list[tuple[int, float, float | None]]


def cv_grid(train: DataFrame, names: list[str], c_values=(0.01, 1.0, 100.0), folds: int = 5, label: str = "status", fold: str = "fold") -> Grid:
    """k-fold search over C on rows that carry their ``fold`` (0 .. folds - 1): all folds, all C and the final fits in one batch.

    The best C has the highest mean AUC over the folds, the first of equals."""
    from .metrics import roc_auc
    rows = through_files(train.select(*[F.col(f"`{n}`") for n in names], F.col(label).alias("y"), F.col(fold).alias("fold")), "grid-rows")
    problems = [Problem(f, float(c)) for f in range(folds) for c in c_values] + [Problem(None, float(c)) for c in c_values]
    fits, rounds = fit_all(rows, names, problems)
    scores = through_files(held_out_scores(rows, names, fits), "grid-scores", ["fold", "C"])
    aucs = roc_auc(scores, ["fold", "C"]).collect()                      # one row a fold and C
    means = {float(c): float(np.mean([r["auc_roc"] for r in aucs if r["C"] == c and r["auc_roc"] is not None] or [np.nan])) for c in c_values}
    top = max(c_values, key=lambda c: (-np.inf if np.isnan(means[float(c)]) else means[float(c)]))
    return Grid(means, fits, scores, next(p for p in fits if p.left_out is None and p.C == float(top)), rounds,
                [(r["fold"], r["C"], r["auc_roc"]) for r in aucs])
