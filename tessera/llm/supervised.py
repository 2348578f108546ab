"""What the trained operators share: held-out folds, a bounded sample of labelled rows, logistic regression.

Models are fitted on at most ``SAMPLE`` labelled documents, those with the smallest hash of their id; everything that
is applied or counted over the corpus afterwards covers every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

SAMPLE = 12_000


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """_text and _label of up to ``most`` labelled documents outside the held-out fold, equal texts once.

    Contradictory labels of one id or text count as the larger. The ids are at most ``most`` rows, hence the broadcast.
    """
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = written(rows.select(F.col("doc_id").alias("_id"), "_label"), "label-sample")
    found = docs.select(F.col(key).alias("_id"), text_of(docs, text).alias("_text")).join(F.broadcast(rows), "_id")
    return written(found.groupBy("_text").agg(F.max("_label").alias("_label")), "text-sample")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method with an L2 penalty on all but the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x) or y.min() == y.max():  # one class alone: its rate, no slopes
        w[-1] = 0.0 if not len(x) else (6.0 if y[0] else -6.0)
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w
