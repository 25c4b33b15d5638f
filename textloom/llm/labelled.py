"""Labelled rows for the trained operators: which rows may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): at most ``most`` labelled rows that aren't held out, chosen by a hash of the id.

    Null ids and null labels are left out; of repeated ids the greatest label and the least text count.  At most ``most`` ids
    are broadcast, and the rows are written, so that the table is read once.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return written(found, f"sample-{label}")


def logistic(x, y, steps: int = 400, penalty: float = 1e-3):
    """Weights and intercept of a penalised logistic regression by Newton's method (numpy arrays in, numpy out)."""
    import numpy as np

    full = np.c_[x, np.ones(len(x))]
    w = np.zeros(full.shape[1])
    ridge = np.full(full.shape[1], penalty * len(x))
    ridge[-1] = 1e-9
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - y) + ridge * w
        hess = (full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1]
