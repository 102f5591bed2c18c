"""Weighted logistic regression by Newton's method as distributed sums (L3).

The objective is that of a ridge classifier with C = 1 / ``l2``: the sum of weight x log-loss plus
l2 / 2 times the squared coefficients of the raw features, intercept free. It is convex, so its
minimum is one value whatever method finds it. Each pass is one aggregate over the training rows:
loss, gradient and upper triangle of the Hessian, (d + 1)(d + 2) / 2 + d + 2 sums that combine map-side.
The driver holds only these sums and solves a (d + 1) x (d + 1) system; no row reaches it. Near ten
passes are usual, because the step is quadratic near the minimum; a step that raises the loss is halved.

Features are centred and scaled inside the pass (one aggregate before), which keeps the system well
conditioned for amounts next to rates; the coefficients given back are those of the raw features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PASSES = 100
TOLERANCE = 1e-13


@dataclass(frozen=True)
class Model:
    """Coefficients of the raw features; ``scales`` are their weighted deviations (1 if constant)."""
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    scales: tuple[float, ...]
    loss: float
    passes: int
    converged: bool

    def margin(self) -> Column:
        """Log-odds of a row; positive predicts class 1."""
        return linear(self.intercept, zip(self.coefficients, [F.col(f).cast("double") for f in self.features]))


def linear(intercept: float, terms) -> Column:
    out = F.lit(float(intercept))
    for b, x in terms:
        out = out + F.lit(float(b)) * x
    return out


def moments(train: DataFrame, features, weight: str) -> tuple[list[float], list[float]]:
    """Weighted mean and deviation of each feature; the second pass is centred."""
    w = F.col(weight)
    first = train.agg(F.sum(w), *[F.sum(w * F.col(f)) for f in features]).first()
    means = [s / first[0] for s in first[1:]]
    second = train.agg(*[F.sum(w * (F.col(f) - F.lit(float(m))) * (F.col(f) - F.lit(float(m)))) for f, m in zip(features, means)]).first()
    scales = [(v / first[0]) ** 0.5 for v in second]
    return means, [s if s > 1e-12 * max(1.0, abs(m)) else 1.0 for s, m in zip(scales, means)]


def fit(train: DataFrame, features, label: str = "label", weight: str = "weight", l2: float = 1.0,
        max_passes: int = MAX_PASSES, tolerance: float = TOLERANCE) -> Model:
    """Minimum of the objective over ``train`` (not empty, no nulls in the used columns).

    ``train`` is read once a pass: give a written or checkpointed table. The loop ends when half the
    Newton decrement is at most ``tolerance`` of the loss; ``converged`` says whether it did.
    """
    features = tuple(features)
    d = len(features)
    rows = train.select(F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"),
                        *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)])
    names = [f"_x{j}" for j in range(d)]
    means, scales = moments(rows, names, "_w")
    x = [F.lit(1.0), *[(F.col(n) - F.lit(float(m))) / F.lit(float(s)) for n, m, s in zip(names, means, scales)]]
    ridge = np.array([0.0, *[l2 / s ** 2 for s in scales]])
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    z, y, w, p, r, v = (F.col(c) for c in ("_z", "_y", "_w", "_p", "_r", "_v"))

    def sums(beta):
        at = rows.select("_y", "_w", *[c.alias(f"_s{j}") for j, c in enumerate(x)], linear(0.0, zip(beta, x)).alias("_z"))
        at = at.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        at = at.withColumn("_r", w * (p - y)).withColumn("_v", w * p * (F.lit(1.0) - p))
        s = [F.col(f"_s{j}") for j in range(d + 1)]
        loss = F.sum(w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z))
        got = at.agg(loss, *[F.sum(r * c) for c in s], *[F.sum(v * s[i] * s[j]) for i, j in upper]).first()
        hessian = np.zeros((d + 1, d + 1))
        for (i, j), h in zip(upper, got[d + 2:]):
            hessian[i, j] = hessian[j, i] = h
        return (got[0] + 0.5 * float(ridge @ (beta * beta)), np.array(got[1:d + 2]) + ridge * beta, hessian + np.diag(ridge))

    beta, best = np.zeros(d + 1), None
    step, passes, converged = np.zeros(d + 1), 0, False
    while passes < max_passes:
        loss, gradient, hessian = sums(beta + step)
        passes += 1
        if best is not None and loss > best * (1 + 1e-12) and np.abs(step).max() > 1e-12:
            step = step / 2
            continue
        beta, best = beta + step, loss
        step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if -float(gradient @ step) / 2 <= tolerance * (abs(best) + 1e-300):
            beta, converged = beta + step, True
            break
    raw = [b / s for b, s in zip(beta[1:], scales)]
    intercept = float(beta[0] - sum(b * m for b, m in zip(raw, means)))
    return Model(features, intercept, tuple(float(b) for b in raw), tuple(float(s) for s in scales), float(best), passes, converged)
