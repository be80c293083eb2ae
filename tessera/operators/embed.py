"""Embeddings of graphs: fuzzy and binary graphs, t-SNE affinities, spectral starts, UMAP and t-SNE layouts.

Graph preparation is distributed. A layout by gradient descent is sequential over its steps and needs all
points at once, in one task whose steps and memory grow in proportion to points and edges: the points are counted first, and more
than MOST_POINTS raise TooLarge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.table import beside
from tessera.session import bounded, prepare

MOST_POINTS = 1_000_000
#: Points up to which the repulsion of a t-SNE layout is summed over all pairs.
MOST_PAIRED = 5_000


def prepared(graph: DataFrame) -> DataFrame:
    """Non-finite distances become the row's largest finite one."""
    finite = F.when((F.col("dist") < float("inf")) & ~F.isnan("dist"), F.col("dist"))
    top = graph.groupBy("i").agg(F.max(finite).alias("top"))
    return graph.join(top, "i").select("i", "rank", "j", F.coalesce(finite, "top", F.lit(0.0)).alias("dist"))


def _rows(graph: DataFrame) -> DataFrame:
    """One row a node, its neighbours by rank: as many as the graph is wide."""
    e = F.array_sort(F.collect_list(F.struct("rank", "j", "dist")))
    return graph.groupBy("i").agg(F.transform(e, lambda x: x["j"]).alias("js"), F.transform(e, lambda x: x["dist"]).alias("ds"))


def _padded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows x neighbours of distances, and which are there."""
    size = pdf["ds"].map(len).to_numpy()
    there = np.arange(size.max(initial=0))[None, :] < size[:, None]
    d = np.zeros(there.shape)
    d[there] = np.concatenate([np.asarray(x, float) for x in pdf["ds"]])
    return d, there


def _edges(pdf: pd.DataFrame, w: np.ndarray, there: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": np.repeat(pdf["i"].to_numpy(), there.sum(axis=1)), "j": np.concatenate([np.asarray(x) for x in pdf["js"]]), "w": w[there]})


def fuzzy_graph(graph: DataFrame) -> DataFrame:
    """(a, b, w), a < b: smooth neighbour weights exp(-(d - rho) / sigma), united by a + b - ab; w <= 1e-6 goes.

    rho is the least positive distance; sigma by bisection (64 steps, all rows of a batch together) so that the
    weights add up to log2(k), at least a thousandth of the row's mean distance.
    """
    prepare(graph.sparkSession)

    def weights(over: np.ndarray, s: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, np.where(over > 0, np.exp(-np.maximum(over, 0) / s[:, None]), 1.0), 0.0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            d, there = _padded(pdf)
            size = there.sum(axis=1)
            rho = np.where(there & (d > 0), d, np.inf).min(axis=1)
            over = d - np.where(np.isfinite(rho), rho, 0.0)[:, None]
            want = np.log2(np.maximum(2, size))
            lo, hi, s, on = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.arange(len(d))
            for _ in range(64):
                got = weights(over[on], s[on], there[on]).sum(axis=1)
                left = np.abs(got - want[on]) >= 1e-5
                on, got = on[left], got[left]
                if not len(on):
                    break
                much = got > want[on]
                hi[on[much]], lo[on[~much]] = s[on[much]], s[on[~much]]
                s[on] = np.where(np.isinf(hi[on]), s[on] * 2, (lo[on] + np.where(np.isinf(hi[on]), 0, hi[on])) / 2)
            s = np.maximum(np.maximum(s, 1e-3 * d.sum(axis=1) / np.maximum(1, size)), 1e-12)
            yield _edges(pdf, weights(over, s, there), there)

    w = _rows(prepared(graph)).mapInPandas(run, "i long, j long, w double").where("i <> j")
    return fuzzy_union(w)


def fuzzy_union(w: DataFrame) -> DataFrame:
    """(i, j, w) -> (a, b, w): a + b - ab over both directions, w > 1e-6."""
    both = w.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(F.when(F.col("i") < F.col("j"), F.col("w"))).alias("x"), F.max(F.when(F.col("i") > F.col("j"), F.col("w"))).alias("y"))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.select("a", "b", (x + y - x * y).alias("w")).where("w > 1e-6")


def affinities(graph: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """(a, b, w), a < b: each row's Gaussian of the given perplexity (200 bisections), both directions added, all weights adding up to 1 (an edge counts twice)."""
    prepare(graph.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            d, there = _padded(pdf)
            d = np.where(there, np.square(d), np.inf)
            d = np.where(there, d - d.min(axis=1, keepdims=True), 0.0)
            want = np.log(np.minimum(perplexity, there.sum(axis=1)))
            lo, hi, beta, on = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.arange(len(d))
            for _ in range(200):
                p = np.where(there[on], np.exp(-beta[on, None] * d[on]), 0.0)
                total = p.sum(axis=1)
                h = np.log(total) + beta[on] * (p * d[on]).sum(axis=1) / total
                left = np.abs(h - want[on]) >= 1e-5
                on, h = on[left], h[left]
                if not len(on):
                    break
                flat = h > want[on]
                lo[on[flat]], hi[on[~flat]] = beta[on[flat]], beta[on[~flat]]
                beta[on] = np.where(np.isinf(hi[on]), beta[on] * 2, (lo[on] + np.where(np.isinf(hi[on]), 0, hi[on])) / 2)
            p = np.where(there, np.exp(-beta[:, None] * d), 0.0)
            yield _edges(pdf, p / p.sum(axis=1, keepdims=True), there)

    w = _rows(graph).mapInPandas(run, "i long, j long, w double").where("i <> j")
    both = w.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("w"))
    total = both.agg((2 * F.sum("w")).alias("t"))
    return both.transform(beside, total).select("a", "b", (F.col("w") / F.col("t")).alias("w"))


def curve(min_dist: float = 0.01, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)) fitted to the layout's target curve by Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):
        t = x ** (2 * b)
        f = 1 / (1 + a * t)
        j = np.stack([-t * f * f, -a * t * 2 * np.log(x) * f * f], axis=1)
        step = np.linalg.lstsq(j, y - f, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-3, b + 0.5 * step[1])
    return float(a), float(b)


def _layout(edges: DataFrame, start: DataFrame, kernel, most: int) -> DataFrame:
    """start(id, vec), edges(a, b, w) in one task, whose points are counted first."""
    prepare(edges.sparkSession)
    bounded(start, most, "points of a layout")
    p = start.select(F.lit(0).alias("g"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    e = edges.select(F.lit(0).alias("g"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))

    def run(key: tuple, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p, e = p.sort_values("id"), e.sort_values(["a", "b"])
        ids = p["id"].to_numpy()
        y = kernel(np.array(p["vec"].tolist(), float), np.searchsorted(ids, e["a"]), np.searchsorted(ids, e["b"]), e["w"].to_numpy())
        return pd.DataFrame({"id": ids, "vec": list(y)})

    e = e.toDF(*e.columns)  # apart from p, which may stem from the same tables
    return p.groupBy("g").cogroup(e.groupBy("g")).applyInPandas(run, "id long, vec array<double>")


def spectral_start(edges: DataFrame, nodes: DataFrame, dims: int = 2, seed: int = 1234, most: int = MOST_POINTS) -> DataFrame:
    """(id, vec): leading eigenvectors but the first of the normalised graph, by subspace iteration; the largest value is 10."""

    def kernel(x, a, b, w):
        n = len(x)
        degree = np.bincount(a, w, n) + np.bincount(b, w, n)
        s = w / np.sqrt(np.maximum(degree[a] * degree[b], 1e-300))
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, dims + 4))))[0]
        for _ in range(100):
            z = q.copy()  # shifted by the identity: all eigenvalues at least 0
            for c in range(q.shape[1]):
                z[:, c] += np.bincount(a, s * q[b, c], n) + np.bincount(b, s * q[a, c], n)
            q = np.linalg.qr(z)[0]
        m = q.T @ np.stack([q[:, c] + np.bincount(a, s * q[b, c], n) + np.bincount(b, s * q[a, c], n) for c in range(q.shape[1])], axis=1)
        vectors = q @ np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
        y = np.zeros((n, dims))
        y[:, : min(dims, vectors.shape[1] - 1)] = vectors[:, 1 : dims + 1]
        y *= np.where(y[np.abs(y).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
        return y * 10.0 / max(np.abs(y).max(), 1e-12)

    return _layout(edges, nodes.select("id", F.array(F.lit(0.0)).alias("vec")), kernel, most)


def umap_layout(edges: DataFrame, start: DataFrame, epochs: int = 200, negatives: int = 5, min_dist: float = 0.01, seed: int = 1234, most: int = MOST_POINTS) -> DataFrame:
    """(id, vec): two dimensions by stochastic descent on the fuzzy graph (a, b, w); an edge is used as often as its weight asks."""
    ab = curve(min_dist)

    def kernel(y, a, b, w):
        if y.shape[1] != 2:
            raise ValueError("two dimensions")
        rng, n, (ca, cb) = np.random.default_rng(seed), len(y), ab
        head, tail, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        every = weight.max(initial=0) / np.maximum(weight, 1e-12)
        due = every.copy()
        for epoch in range(1, epochs + 1):
            rate = 1.0 - (epoch - 1) / epochs
            now = np.flatnonzero(due <= epoch)
            due[now] += every[now]
            i, j = head[now], tail[now]
            gap = y[i] - y[j]
            d2 = (gap**2).sum(axis=1)
            pull = np.where(d2 > 0, -2 * ca * cb * np.power(np.maximum(d2, 1e-12), cb - 1) / (1 + ca * np.power(d2, cb)), 0.0)
            move = np.clip(pull[:, None] * gap, -4, 4)
            step = np.zeros_like(y)
            ends = np.concatenate([i, j])
            for c in range(2):
                step[:, c] += np.bincount(ends, np.concatenate([move[:, c], -move[:, c]]), n)
            for u in range(0, len(i), 262_144):  # a stretch of edges after another, so that their draws are never held at once
                k = np.repeat(i[u : u + 262_144], negatives)
                o = rng.integers(0, n, len(k))
                gap = y[k] - y[o]
                d2 = (gap**2).sum(axis=1)
                push = 2 * cb / ((0.001 + d2) * (1 + ca * np.power(d2, cb)))
                move = np.clip(push[:, None] * gap, -4, 4)
                move[k == o] = 0
                for c in range(2):
                    step[:, c] += np.bincount(k, move[:, c], n)
            count = np.maximum(1.0, np.bincount(np.concatenate([i, j]), minlength=n) / 4)[:, None]  # one step at once, not one edge after another
            y = y + rate * np.clip(step / count, -4, 4)
        return y

    return _layout(edges, start, kernel, most)


class Repulsion:
    """Sums over all pairs of points in the plane by a grid: charges go to the 4 x 4 nodes around a point (cubic interpolation), meet by FFT, and come back.

    A quarter of the kernel's unit lies between nodes, less where the points lie within 16 units, more beyond 508 (there near points repel less exactly).
    """

    STEP, LEAST, MOST = 0.25, 64, 2_032

    def __init__(self):
        self.key, self.kernels = None, None

    def _spectra(self, m: int, h: float) -> tuple[np.ndarray, np.ndarray]:
        """Of 1 / (1 + d^2) and its square over a grid of twice m nodes, which goes round."""
        if self.key != (m, h):
            d = np.square(h * np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m)))
            q = 1 / (1 + d[:, None] + d[None, :])
            self.key, self.kernels = (m, h), (np.fft.rfft2(q), np.fft.rfft2(q * q))
        return self.kernels

    def __call__(self, y: np.ndarray) -> tuple[float, np.ndarray]:
        """(the sum of q over ordered pairs, each point's sum of q^2 times its gap to the others), q = 1 / (1 + d^2)."""
        low, span = y.min(axis=0), max(float(np.ptp(y, axis=0).max()), 1e-12)
        h = min(span / self.LEAST, self.STEP) if span <= self.STEP * self.MOST else self.STEP * 2.0 ** (np.ceil(4 * np.log2(span / (self.STEP * self.MOST))) / 4)
        m = 64 * (int(span / h) // 64 + 1) + 8
        at = (y - low) / h
        first = np.floor(at).astype(np.int64)
        t = at - first
        w = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])  # nodes -1 to 2 from the one below
        places = [(first[:, 0] + a) * m + first[:, 1] + b for a in range(4) for b in range(4)]
        weights = [w[a, :, 0] * w[b, :, 1] for a in range(4) for b in range(4)]
        kq, kq2 = self._spectra(m, h)

        def spectrum(charge: np.ndarray | None) -> np.ndarray:
            grid = np.zeros(m * m)
            for p, v in zip(places, weights, strict=True):
                grid += np.bincount(p, v if charge is None else v * charge, m * m)
            return np.fft.rfft2(grid.reshape(m, m), (2 * m, 2 * m))

        def field(s: np.ndarray) -> np.ndarray:
            grid = np.fft.irfft2(s, (2 * m, 2 * m))[:m, :m].ravel()
            out = np.zeros(len(y))
            for p, v in zip(places, weights, strict=True):
                out += v * grid[p]
            return out

        mass = spectrum(None)
        lag = [sum((1 + (k > 0)) * w[a] * w[a + k] for a in range(4 - k)) for k in range(4)]  # what a point's charge is to itself
        own = sum((lag[k][:, 0] * lag[l][:, 1] / (1 + (k * k + l * l) * h * h)).sum() for k in range(4) for l in range(4))
        z, near = field(mass * kq).sum() - own, field(mass * kq2)
        return float(z), near[:, None] * y - np.stack([field(spectrum(y[:, c]) * kq2) for c in range(2)], axis=1)


def _paired(y: np.ndarray) -> tuple[float, np.ndarray]:
    """As Repulsion, over all pairs."""
    sq = (y**2).sum(axis=1)
    q = 1 / (1 + np.maximum(sq[:, None] + sq[None] - 2 * y @ y.T, 0))
    np.fill_diagonal(q, 0)
    rep = q * q
    return q.sum(), rep.sum(axis=1)[:, None] * y - rep @ y


def tsne_layout(edges: DataFrame, start: DataFrame, perplexity: float = 30.0, early: tuple[int, float] = (250, 12.0), late: int = 500, momentum: float = 0.8, most: int = MOST_POINTS) -> DataFrame:
    """(id, vec): t-SNE on affinities (a, b, w): early exaggeration, then plain steps; rate n / exaggeration, gains, steps clipped at 5. n - 1 >= 3 perplexity or ValueError.

    The attraction is exact; so is the repulsion of up to MOST_PAIRED points, that of more in the plane is summed by Repulsion's grid, in steps
    that don't grow with the pairs.
    """
    n = bounded(start, most, "points of a layout")
    if n - 1 < 3 * perplexity:
        raise ValueError("too few points for the perplexity")

    def kernel(y, a, b, w):
        n = len(y)
        many = n > MOST_PAIRED and y.shape[1] == 2
        repulsion = Repulsion() if many else _paired
        move, gain = np.zeros_like(y), np.ones_like(y)
        for steps, factor in (early, (late, 1.0)):
            rate = n / factor
            for _ in range(steps):
                z, away = repulsion(y)
                grad = -away / z
                gap = y[a] - y[b]
                if many:
                    f = factor * w / (1 + (gap**2).sum(axis=1))
                    for c in range(2):
                        pull = f * gap[:, c]
                        grad[:, c] += np.bincount(a, pull, n) - np.bincount(b, pull, n)
                else:
                    q = 1 / (1 + np.maximum((y[a] ** 2).sum(axis=1) + (y[b] ** 2).sum(axis=1) - 2 * (y[a] * y[b]).sum(axis=1), 0))
                    f = (factor * w * q)[:, None] * gap
                    np.add.at(grad, a, f)
                    np.add.at(grad, b, -f)
                grad *= 4
                same = np.sign(grad) == np.sign(move)
                gain = np.maximum(np.where(same, gain * 0.8, gain + 0.2), 0.01)
                move = momentum * move - rate * gain * grad
                size = np.sqrt((move**2).sum(axis=1, keepdims=True))
                move *= np.minimum(1, 5 / np.maximum(size, 1e-12))
                y = y + move
                y -= y.mean(axis=0)
        return y

    return _layout(edges, start, kernel, most)
