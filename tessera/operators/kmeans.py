"""k-means by Lloyd's steps; centroids are few and travel, rows stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.session import prepare, written

from .sampling import shuffled


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the first, and its squared distance; sums run over the columns in order."""
    d = np.zeros((len(x), len(c)))
    for k in range(x.shape[1]):
        diff = x[:, k, None] - c[None, :, k]
        d += diff * diff
    return d.argmin(axis=1), d.min(axis=1)


def _stretches(it: Iterator[pd.DataFrame], c: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    step = max(1, 2_000_000 // max(1, len(c)))
    for pdf in it:
        for a in range(0, len(pdf), step):
            part = pdf.iloc[a : a + step]
            x = np.array(part["vec"].tolist(), float).reshape(len(part), -1)
            yield part, x, *_nearest(x, c)


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster from 1, d2): the nearest centroid, ties to the smaller number."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, near, d2 in _stretches(it, shared.value):
            yield pd.DataFrame({"id": part["id"], "cluster": near + 1, "d2": d2})

    return rows.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec")).mapInPandas(run, "id long, cluster int, d2 double")


def step(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, counts) of the clusters around the centroids: tasks return sums of clusters x columns, rows don't move. A cluster without rows keeps its centroid."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    dims = centroids.shape[1]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        total = np.zeros((len(c), dims + 1))
        for _, x, near, _ in _stretches(it, c):
            np.add.at(total, near, np.concatenate([x, np.ones((len(x), 1))], axis=1))
        some = np.flatnonzero(total[:, dims])
        yield pd.DataFrame({"cluster": np.repeat(some, dims + 1), "c": np.tile(np.arange(dims + 1), len(some)), "v": total[some].ravel()})

    sums = np.zeros((len(centroids), dims + 1))
    found = rows.select(V.doubles(F.col("vec")).alias("vec")).mapInPandas(run, "cluster long, c long, v double").groupBy("cluster", "c").agg(F.sum("v").alias("v"))
    for r in found.toLocalIterator():  # clusters x columns
        sums[r.cluster, r.c] = r.v
    n = sums[:, dims]
    return np.where(n[:, None] > 0, sums[:, :dims] / np.maximum(n, 1)[:, None], centroids), n


def kmeans(rows: DataFrame, k: int, steps: int = 10, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster from 1), centroids): starts from the first k rows in shuffled order, stops when no centroid moves.

    A cluster left without rows takes the row farthest from its centroid (the smallest id of these).
    """
    first = [r.id for r in rows.select("id").orderBy(shuffled(seed, "id"), "id").limit(k).collect()]  # ids only leave the tasks
    start = {r.id: r.vec for r in rows.select("id", V.doubles(F.col("vec")).alias("vec")).where(F.col("id").isin(first)).collect()}
    c = np.array([start[i] for i in first], float)
    for _ in range(steps - 1):
        new, n = step(rows, c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = assign(rows, c).orderBy(F.desc("d2"), "id").limit(len(empty)).join(rows.select("id", V.doubles(F.col("vec")).alias("vec")), "id").orderBy(F.desc("d2"), "id").collect()
            for j, r in zip(empty, far, strict=False):
                new[j] = np.array(r.vec)
        if np.array_equal(new, c):
            break
        c = new
    return written(assign(rows, c), "clusters").select("id", "cluster"), c
