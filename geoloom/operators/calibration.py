"""Calibration of confidences: a logistic fit by Newton steps on sums that Spark takes, and exact contributions to the log-odds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LABELS = 200  # fewer are not enough to show a probability
STEPS, CLOSE = 25, 1e-12


@dataclass(frozen=True)
class Calibration:
    """p = 1 / (1 + exp(-(intercept + sum of coefficient x feature))), from so many labels."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    labels: int

    @property
    def shown(self) -> bool:
        return self.labels >= LEAST_LABELS

    def contribution(self, feature: str) -> Column:
        return F.col(feature) * F.lit(self.coefficients[self.features.index(feature)])

    def probability(self) -> Column:
        """Null where there are too few labels or a feature is missing."""
        logit = F.lit(self.intercept)
        for f in self.features:
            logit = logit + self.contribution(f)
        return F.when(F.lit(self.shown), 1 / (1 + F.exp(-logit)))


def fit(rows: DataFrame, label: str, features: Sequence[str], l2: float = 0.0) -> Calibration:
    """A fit of label (0 or 1) on numeric features over all rows without a null among them.

    One pass for each Newton step adds up the gradient and the second derivatives, a few numbers whatever the rows; a
    step that cannot be solved (no labels, or features that repeat each other) ends the fit at what was reached.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    able = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [label, *features]))
    y, d = F.col(label).cast("double"), len(x)
    beta, n = np.zeros(d), 0
    for _ in range(STEPS):
        z = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.count("*")] + [F.sum((y - p) * v) for v in x] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(d) for j in range(i, d)]
        n, *found = able.agg(*sums).first()
        if not n:
            break
        gradient = np.array(found[:d]) - l2 * beta * (np.arange(d) > 0)
        second = np.zeros((d, d))
        second[np.triu_indices(d)] = found[d:]
        second = second + np.triu(second, 1).T + l2 * np.diag(np.arange(d) > 0)
        try:
            step = np.linalg.solve(second, gradient)
        except np.linalg.LinAlgError:
            break
        beta = beta + step
        if np.abs(step).max() < CLOSE:
            break
    return Calibration(tuple(features), float(beta[0]), tuple(map(float, beta[1:])), int(n))


def level(p: Column, confirmed: Column) -> Column:
    """LOW below 0.4, MEDIUM below 0.7, else HIGH, which only confirmed events have; none without a probability."""
    return F.when(p.isNull(), F.lit(None)).when(p < 0.4, "LOW").when((p < 0.7) | ~confirmed, "MEDIUM").otherwise("HIGH")
