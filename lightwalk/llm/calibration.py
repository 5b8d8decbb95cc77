"""Labelled samples of bounded size, and logistic calibration of a classifier's raw features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def remainder(doc_id: F.Column, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_samples(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, per_class: int, calibration: int) -> DataFrame:
    """(doc_id, label int, role, text) of labelled documents to learn from, of two disjoint roles.

    "example": at most ``per_class`` of each label; "calibration": at most ``calibration`` at the labels' own proportions.
    Both are chosen by a hash of the id, so the choice is spread over the corpus and the same on every run. Only the
    ids of the sample are sent to the documents. Where a document has several labels the largest counts; of repeated
    document ids one text is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    side = F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(3))  # a third calibrates
    order = F.xxhash64("doc_id")
    chosen = known.where(side == 0).orderBy(order, "doc_id").limit(calibration).withColumn("role", F.lit("calibration"))
    for value in (0, 1):
        part = known.where((side != 0) & (F.col("label") == value)).orderBy(order, "doc_id").limit(per_class)
        chosen = chosen.unionByName(part.withColumn("role", F.lit("example")))
    chosen = common.materialize(chosen, "sample-ids")  # at most calibration + 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "role").agg(F.min("text").alias("text"))
    return common.materialize(found, "sample")


@dataclass
class Logistic:
    """A logistic model over standardised features and, if asked for, their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    squares: bool = True

    @staticmethod
    def _wide(x: np.ndarray, squares: bool) -> np.ndarray:
        return np.column_stack([x, x**2]) if squares else x

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, squares: bool = True, steps: int = 50) -> Logistic:
        """Damped Newton steps with a ridge; without rows of both labels, the labels' smoothed mean."""
        wide = cls._wide(np.asarray(x, float), squares)
        mean, scale = (wide.mean(0), wide.std(0)) if len(y) else (np.zeros(wide.shape[1]), np.ones(wide.shape[1]))
        scale = np.where(scale > 1e-9, scale, 1.0)
        base = (y.sum() + 0.5) / (len(y) + 1)
        weights = np.zeros(1 + wide.shape[1])
        weights[0] = np.log(base / (1 - base))
        if 0 < y.sum() < len(y):
            a = np.column_stack([np.ones(len(y)), (wide - mean) / scale])
            penalty = np.full(len(weights), ridge)
            penalty[0] = 0
            fit = lambda w: np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w)).sum() + penalty @ w**2 / 2
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(a @ weights, -30, 30)))
                hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6)
                step = np.linalg.solve(hessian, a.T @ (y - p) - penalty * weights)
                before, size = fit(weights), 1.0
                while fit(weights + size * step) > before and size > 1e-6:  # a full step may overshoot
                    size /= 2
                if size <= 1e-6:
                    break
                weights = weights + size * step
                if np.abs(size * step).max() < 1e-8:
                    break
        return cls(mean, scale, weights, squares)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        wide = (self._wide(np.asarray(x, float), self.squares) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + np.clip(wide, -8, 8) @ self.weights[1:], -30, 30)))
