"""PCA, partial least squares and discriminants from sums of products.

Rows are read once for their (per fold) counts, sums and products of columns, added up in Spark; the small
dense algebra is NumPy on the driver, and models go back to score rows. Nothing on the driver grows with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.functions.table import beside
from tessera.session import prepare

SPAN = 1e-10


@dataclass
class Moments:
    """Count, sums and products of columns [x, y]."""

    n: float
    s: np.ndarray
    p: np.ndarray

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.s + o.s, self.p + o.p)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.s - o.s, self.p - o.p)


def moments(rows: DataFrame, by: str | None = None, classes: list | None = None, y: str | None = None) -> dict[tuple[int, int], Moments]:
    """(group of by, class) -> Moments of rows(vec[, by][, label][, y]); classes: the labels, else one class 0."""
    prepare(rows.sparkSession)
    cols = [V.doubles(F.col("vec")).alias("vec"), (F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("g")]
    cols.append((F.col("label") if classes else F.lit(0)).alias("label"))
    if y:
        cols.append(V.doubles(F.col(y)).alias("y"))
    code = {c: i for i, c in enumerate(classes or [0])}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list] = {}
        for pdf in it:
            x = np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)
            if y:
                x = np.concatenate([x, np.array(pdf["y"].tolist(), float).reshape(len(pdf), -1)], axis=1)
            if not np.isfinite(x).all():
                raise ValueError("values must be finite")
            keys = pdf["g"].to_numpy() * len(code) + pdf["label"].map(code).to_numpy()
            for key in np.unique(keys):
                own = x[keys == key]
                part = [float(len(own)), own.sum(axis=0), own.T @ own]
                k = divmod(int(key), len(code))
                total[k] = [a + b for a, b in zip(total[k], part, strict=True)] if k in total else part
        for (g, c), (n, s, p) in total.items():
            flat = np.concatenate([[n], s, p.ravel()])
            yield pd.DataFrame({"g": g, "k": c, "at": np.arange(len(flat)), "v": flat})

    out: dict[tuple[int, int], dict[int, float]] = {}
    for r in rows.select(*cols).mapInPandas(run, "g long, k long, at long, v double").groupBy("g", "k", "at").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault((r.g, r.k), {})[r.at] = r.v
    found = {}
    for key, v in out.items():
        flat = np.array([v[i] for i in range(len(v))])
        p = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
        found[key] = Moments(flat[0], flat[1 : 1 + p], flat[1 + p :].reshape(p, p))
    return found


def total(parts: dict) -> Moments:
    it = iter(parts.values())
    out = next(it)
    for m in it:
        out = out + m
    return out


# principal components


@dataclass
class PCA:
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # columns x components
    variances: np.ndarray
    shares: np.ndarray


def pca(rows: DataFrame, components: int = 2, center: bool = True, scale: bool = False) -> tuple[DataFrame, PCA]:
    """((id, vec) scores, model): each component's largest loading is positive; a zero sd counts as 1."""
    m = moments(rows)[0, 0]
    mean = m.s / m.n if center else np.zeros(len(m.s))
    cov = (m.p - np.outer(m.s, mean) - np.outer(mean, m.s) + m.n * np.outer(mean, mean)) / max(1.0, m.n - 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) if scale else np.ones(len(cov))
    sd = np.where(sd > 0, sd, 1.0)
    cov = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    load = vectors[:, order]
    load = load * np.where(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    model = PCA(mean, sd, load, np.maximum(values[order], 0), np.maximum(values[order], 0) / max(np.trace(cov), 1e-300))
    return project(rows, mean, sd, load), model


def project(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, offset: np.ndarray | None = None) -> DataFrame:
    """(id, vec): ((x - mean) / scale) weights + offset."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((mean, scale, weights, np.zeros(weights.shape[1]) if offset is None else offset))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, scale, w, add = shared.value
        for pdf in it:
            x = np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)
            yield pd.DataFrame({"id": pdf["id"], "vec": list(((x - mean) / scale) @ w + add)})

    return rows.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec")).mapInPandas(run, "id long, vec array<double>")


def starting_layout(scores: DataFrame, method: str, seed: int = 1234) -> DataFrame:
    """Scores as a start for an embedding. opentsne: the largest sd is 1e-4; umap: the largest value is 10, plus N(0, 1e-4), centred."""
    long = scores.select(F.posexplode("vec").alias("c", "v"))
    if method == "opentsne":
        top = long.groupBy("c").agg(F.stddev_pop("v").alias("s")).agg(F.max("s")).first()[0] or 1.0
        return scores.select("id", F.transform("vec", lambda v: v * F.lit(1e-4 / top)).alias("vec"))
    from .spatial import hashed_uniform

    top = long.agg(F.max(F.abs("v"))).first()[0] or 1.0
    noise = lambda i: F.sqrt(-2 * F.log(1 - hashed_uniform(seed, F.col("id"), F.concat(F.lit("r"), i)))) * F.cos(2 * np.pi * hashed_uniform(seed, F.col("id"), F.concat(F.lit("a"), i)))
    moved = scores.select("id", F.transform("vec", lambda v, i: v * F.lit(10.0 / top) + 1e-4 * noise(i)).alias("vec"))
    mean = moved.select(F.posexplode("vec").alias("c", "v")).groupBy("c").agg(F.avg("v").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda p: p["m"]).alias("m"))
    return moved.transform(beside, mean).select("id", F.zip_with("vec", "m", lambda v, m: v - m).alias("vec"))


# partial least squares


@dataclass
class PLS:
    x_mean: np.ndarray
    x_scale: np.ndarray
    y_mean: np.ndarray
    weights: np.ndarray  # R: scores are centred, scaled x times R
    x_loadings: np.ndarray
    y_loadings: np.ndarray

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights @ self.y_loadings.T


def simpls(m: Moments, p: int, components: int, center: bool = True, scale: bool = True) -> PLS:
    """SIMPLS from the moments of [x (p columns), y]. A column's scale is sqrt((1 + sum of squares) / (n - 1))."""
    mean = m.s / m.n if center else np.zeros(len(m.s))
    cross = m.p - np.outer(m.s, mean) - np.outer(mean, m.s) + m.n * np.outer(mean, mean)
    sd = np.sqrt((1.0 + np.maximum(np.diag(cross)[:p], 0)) / max(1.0, m.n - 1)) if scale else np.ones(p)
    xx, xy = cross[:p, :p] / np.outer(sd, sd), cross[:p, p:] / sd[:, None]
    s = xy.copy()
    weights, loads, y_loads, basis = [], [], [], []
    for _ in range(min(components, p)):
        values, vectors = np.linalg.eigh(s.T @ s)
        if values[-1] <= SPAN**2:
            break
        r = s @ vectors[:, -1]
        for _ in range(2):  # scores stay orthogonal where columns are nearly exchangeable
            for w in weights:
                r = r - (w @ xx @ r) * w
        size = np.sqrt(max(r @ xx @ r, 0.0))
        if size <= SPAN:
            break
        r = r / size
        load = xx @ r
        v = load.copy()
        for _ in range(2):
            for b in basis:
                v -= (b @ v) * b
        length = np.linalg.norm(v)
        if length <= SPAN:
            break
        v /= length
        basis.append(v)
        s -= np.outer(v, v @ s)
        weights.append(r)
        loads.append(load)
        y_loads.append(xy.T @ r)
    k = len(weights)
    shape = lambda a, rows: np.array(a).T.reshape(rows, k)
    return PLS(mean[:p], sd, mean[p:], shape(weights, p), shape(loads, p), shape(y_loads, xy.shape[1]))


def pls(rows: DataFrame, components: int = 10, center: bool = True, scale: bool = True) -> tuple[DataFrame, DataFrame, PLS]:
    """rows(id, vec, y array) -> ((id, vec) scores, (id, vec) fitted, model)."""
    m = moments(rows, y="y")[0, 0]
    p = rows.select(F.max(F.size("vec"))).first()[0]
    fit = simpls(m, p, components, center, scale)
    return project(rows, fit.x_mean, fit.x_scale, fit.weights), project(rows, fit.x_mean, fit.x_scale, fit.coefficients, fit.y_mean), fit


def _one_hot(parts: dict[int, Moments], classes: list[int]) -> tuple[Moments, list[int]]:
    """Moments of [x, one-hot labels] from each class's; classes that have rows."""
    own = [c for c in classes if c in parts and parts[c].n > 0]
    p = len(parts[own[0]].s)
    n = sum(parts[c].n for c in own)
    s = np.concatenate([sum(parts[c].s for c in own), [parts[c].n for c in own]])
    prod = np.zeros((p + len(own),) * 2)
    prod[:p, :p] = sum(parts[c].p for c in own)
    for i, c in enumerate(own):
        prod[:p, p + i] = prod[p + i, :p] = parts[c].s
        prod[p + i, p + i] = parts[c].n
    return Moments(n, s, prod), own


@dataclass
class Classifier:
    """Linear scores of classes: x A + b, the first largest wins."""

    classes: list
    a: np.ndarray
    b: np.ndarray


def discriminant(parts: dict[int, Moments], labels: list, components: int, method: str = "lda", center: bool = True, scale: bool = True) -> Classifier:
    """PLS on one-hot labels, decoded by LDA in score space or by the fitted responses. One class: that class; nothing to fit: the largest."""
    m, own = _one_hot(parts, sorted(parts))
    names = [labels[c] for c in own]
    p = len(parts[own[0]].s)
    if len(own) == 1:
        return Classifier(names, np.zeros((p, 1)), np.zeros(1))
    fit = simpls(m, p, components, center, scale)
    if not fit.weights.size:
        return Classifier(names, np.zeros((p, len(own))), np.array([parts[c].n for c in own]))
    to_scores = fit.weights / fit.x_scale[:, None]
    if method == "pls":
        a = fit.coefficients / fit.x_scale[:, None]
        return Classifier(names, a, fit.y_mean - fit.x_mean @ a)
    centre = [(parts[c].s / parts[c].n - fit.x_mean) @ to_scores for c in own]
    within = sum(parts[c].p - np.outer(parts[c].s, parts[c].s) / parts[c].n for c in own)
    cov = to_scores.T @ within @ to_scores / max(1.0, m.n - len(own))
    k = len(cov)
    for ridge in np.geomspace(1e-8, 1e-2, 7):
        try:
            low = np.linalg.cholesky(cov + np.eye(k) * max(ridge * np.trace(cov) / k, 1e-300))
            break
        except np.linalg.LinAlgError:
            continue
    else:
        return Classifier(names, np.zeros((p, len(own))), np.array([parts[c].n for c in own]))
    inverse = np.linalg.solve(low.T, np.linalg.solve(low, np.eye(k)))
    a = to_scores @ inverse @ np.array(centre).T
    b = np.array([-0.5 * t @ inverse @ t + np.log(parts[c].n / m.n) for t, c in zip(centre, own, strict=True)])
    return Classifier(names, a, b - fit.x_mean @ a)


def classify(rows: DataFrame, models: dict[int, Classifier], by: str | None = None) -> DataFrame:
    """(id, pred): each row by the model of its group."""
    prepare(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x, out = np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1), np.zeros(len(pdf), np.int64)
            for g in pdf["g"].unique():
                own, m = (pdf["g"] == g).to_numpy(), shared.value[int(g)]
                out[own] = np.array(m.classes)[(x[own] @ m.a + m.b).argmax(axis=1)]
            yield pd.DataFrame({"id": pdf["id"], "pred": out})

    g = F.col(by).cast("long") if by else F.lit(0).cast("long")
    return rows.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec"), g.alias("g")).mapInPandas(run, "id long, pred long")


def pls_cv(rows: DataFrame, folds: DataFrame, components: int = 10, method: str = "lda", center: bool = True, scale: bool = True) -> DataFrame:
    """rows(id, vec, label) -> (id, fold, truth, pred): each fold by a model of the others; all folds' sums come from one pass."""
    labels = sorted(r.label for r in rows.select("label").distinct().collect())
    both = rows.join(folds, "id")
    parts = moments(both, "fold", labels)
    sums: dict[int, Moments] = {}
    for (_, c), m in parts.items():
        sums[c] = sums[c] + m if c in sums else m
    models = {}
    for f in sorted({g for g, _ in parts}):
        rest = {c: sums[c] - parts[f, c] if (f, c) in parts else sums[c] for c in sums}
        rest = {c: m for c, m in rest.items() if m.n > 0}
        models[f] = discriminant(rest, labels, components, method, center, scale)
    pred = classify(both, models, "fold")
    return both.join(pred, "id").select("id", "fold", F.col("label").alias("truth"), "pred")


def pls_predict(train: DataFrame, test: DataFrame, components: int = 10, method: str = "lda") -> DataFrame:
    labels = sorted(r.label for r in train.select("label").distinct().collect())
    parts = {c: m for (_, c), m in moments(train, None, labels).items()}
    return classify(test, {0: discriminant(parts, labels, components, method)})
