"""Bounded samples of labelled documents for the classifiers, and their common parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import own_columns

#: Rows of a class that a classifier is fitted on at most, and their characters together.
PER_CLASS, CLASS_CHARS = 3000, 24_000_000


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; such labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the rows that may be learnt from."""
    return own_columns(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """How many labels of either class may be learnt from."""
    return {0: 0, 1: 0} | {r["label"]: r["count"] for r in _known(labels, label).groupBy("label").count().collect()}


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> pd.DataFrame:
    """doc_id, text and label of at most ``per_class`` rows of each class, by hash of the id, in one fixed order.

    Of texts that would bring their class over ``class_chars`` characters none is taken, so the driver's memory is bounded;
    texts of any other length take part whole.
    """
    known = _known(labels, label)
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class ids
    texts = own_columns(docs, "doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id").withColumn("chars", F.length("text"))
    # The rows are 2 * per_class but for repeated ids, so a window over each class is bounded too.
    rank = Window.partitionBy("label").orderBy(order, "doc_id", F.xxhash64("text"))
    rows = texts.withColumn("before", F.sum("chars").over(rank)).where(F.col("before") <= class_chars).select("doc_id", "text", "label").toPandas()
    rows["order"] = pd.util.hash_array(rows["doc_id"].to_numpy(np.int64))
    return rows.sort_values(["order", "doc_id", "text"]).drop_duplicates("text").reset_index(drop=True)[["doc_id", "text", "label"]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
