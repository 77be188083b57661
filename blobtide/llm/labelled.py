"""Rows whose label may be learned, shared by the two trained text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import in_train

# A label table of at most so many rows (about 100 MB in memory) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text, label) of the documents with a usable label outside the held-out fold.

    Rows of `docs` have doc_id and text. Null ids and null labels are not used; an id whose labels
    disagree is not used; an id with several texts contributes each.
    """
    one = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{column}`").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & in_train(F.col("doc_id"), folds, held_out))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .filter(F.col("label") == F.col("_most"))
        .drop("_most")
    )
    if labels.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    return docs.join(one, "doc_id").select("doc_id", "text", "label")


def logistic(
    features: np.ndarray, labels: np.ndarray, ones: float = 1.0, ridge: float = 1e-4, steps: int = 50
) -> np.ndarray:
    """Weights (the last one the intercept) of a ridge logistic regression, by Newton's method.

    A row with label 1 counts `ones` times.
    """
    weight = np.where(labels == 1, ones, 1.0)
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + penalty @ w
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
