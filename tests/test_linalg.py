import numpy as np
import pytest

from tessera.operators import linalg as L
from tessera.operators import sampling
from tessera.operators.kmeans import kmeans


def frame(spark, x, *more):
    return spark.createDataFrame([(i, [float(v) for v in r], *(m[i] for m in more)) for i, r in enumerate(x)], "id long, vec array<double>" + ", label long" * len(more))


def signal(n=150):
    rng = np.random.default_rng(0)
    y = np.arange(n) % 3
    x = rng.normal(-0.5, 0.25, (n, 6))
    x[np.arange(n), y] += 3
    x[np.arange(n), y + 3] += 3
    return x, [int(v) + 10 for v in y]


def test_pca(spark):
    t = np.arange(80)
    x = np.stack([np.sin(0.1 * t), np.cos(0.07 * t), 0.01 * t, np.sin(0.3 * t) * 0.5, np.cos(0.2 * t)], axis=1)
    scores, m = L.pca(frame(spark, x), 3)
    got = np.array([r.vec for r in scores.orderBy("id").collect()])
    assert np.allclose(m.loadings.T @ m.loadings, np.eye(3), atol=1e-9) and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert (np.diff(m.variances) <= 0).all() and np.allclose(got.var(axis=0, ddof=1), m.variances)
    assert all(m.loadings[np.abs(m.loadings[:, k]).argmax(), k] > 0 for k in range(3))
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(m.variances, s[:3] ** 2 / 79)
    with pytest.raises(Exception, match="finite"):
        L.pca(frame(spark, [[1, float("nan")]]), 1)


def test_pls_regression(spark):
    r, c = np.meshgrid(np.arange(48), np.arange(6), indexing="ij")
    x = np.sin(0.13 * (r + 1) * (c + 1)) + 0.05 * c
    y = np.stack([x @ np.arange(6), x @ np.ones(6) - 1], axis=1)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, vec array<double>, y array<double>")
    scores, fitted, m = L.pls(rows, 6)
    got = np.array([v.vec for v in fitted.orderBy("id").collect()])
    t = np.array([v.vec for v in scores.orderBy("id").collect()])
    assert np.allclose(got, y, atol=1e-6) and np.allclose(t.T @ t, np.eye(t.shape[1]), atol=1e-6)
    ss = np.square(x - x.mean(axis=0)).sum(axis=0)
    assert np.allclose(m.x_scale, np.sqrt((1 + ss) / 47))


@pytest.mark.parametrize("method, least", [("pls", 0.9), ("lda", 0.9)])
def test_cross_validation(spark, method, least):
    x, y = signal()
    f = frame(spark, x, y)
    out = L.pls_cv(f, sampling.folds(f, 5), 5, method).collect()
    assert len(out) == 150 and np.mean([r.truth == r.pred for r in out]) > least


def test_degenerate_classes(spark):
    one = frame(spark, np.ones((20, 3)), [4] * 20)
    assert {r.pred for r in L.pls_cv(one, sampling.folds(one, 4), 3).collect()} == {4}
    flat = frame(spark, np.ones((30, 3)), [1] * 20 + [2] * 10)
    assert {r.pred for r in L.pls_cv(flat, sampling.folds(flat, 5), 3).collect()} == {1}


def test_prediction_of_new_rows(spark):
    x, y = signal(120)
    train, test = frame(spark, x[:90], y[:90]), frame(spark, x[90:], y[90:])
    got = {r.id: r.pred for r in L.pls_predict(train, test, 5).collect()}
    assert np.mean([got[i] == y[90 + i] for i in range(30)]) > 0.9


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    got, centres = kmeans(frame(spark, x), 3)
    by = {r.id: r.cluster for r in got.collect()}
    inertia = sum(np.square(x[i] - centres[by[i] - 1]).sum() for i in by)
    assert set(by.values()) <= {1, 2, 3} and len(by) == 90 and inertia < np.square(x - x.mean(axis=0)).sum()
    assert by == {r.id: r.cluster for r in kmeans(frame(spark, x).repartition(5), 3)[0].collect()}
