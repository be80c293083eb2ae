import numpy as np
import pytest

from tessera.operators import knn, spatial


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def brute(q, b, k, skip_self):
    out = []
    for i, x in enumerate(q):
        d = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in enumerate(b) if not (skip_self and i == j))
        out += [(i, r + 1, j, round(v, 9)) for r, (v, j) in enumerate(d[:k])]
    return out


def rows(df):
    return sorted((r.i, r["rank"], r.j, round(r.dist, 9)) for r in df.collect())


def test_nearest_2d_and_3d(spark):
    base, ask = frame(spark, [(0, 0), (2, 0), (0, 3), (5, 5), (-3, 2)]), frame(spark, [(1, 0), (9, 9), (-4, 2)])
    got = {r.i: (r.j, r.dist) for r in knn.nearest(ask, base).collect()}
    assert got[0] == (0, 1.0) and got[1][0] == 3 and abs(got[1][1] - 32**0.5) < 1e-12 and got[2] == (4, 1.0)


def test_exact_join_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(150, 7)).round(1)
    want = brute(x, x, 6, True)
    assert rows(knn.knn_graph(frame(spark, x), 6)) == want
    monkeypatch.setattr(knn, "BLOCK", 40)
    assert rows(knn.knn_graph(frame(spark, x), 6)) == want
    assert rows(knn.knn_join(frame(spark, x[:20]), frame(spark, x[20:]), 3)) == brute(x[:20], x[20:], 3, False)


def test_edges(spark):
    empty = frame(spark, [])
    some = frame(spark, [(1, 2)])
    assert knn.knn_graph(some, 3).collect() == [] and knn.knn_join(empty, some, 2).collect() == [] and knn.knn_join(some, empty, 2).collect() == []
    with pytest.raises(ValueError):
        knn.knn_join(some, some, 0)
    with pytest.raises(ValueError):
        knn.knn_join(some, some, 1, "other")
    null = spark.createDataFrame([(1, None), (None, [1.0]), (2, [1.0])], "id long, vec array<double>")
    assert rows(knn.knn_join(null, null, 2)) == [(2, 1, 2, 0.0)]


def test_cosine_and_inner_product(spark):
    f = frame(spark, [(1, 0), (2, 0), (0, 0), (0, 3)])
    got = {(r.i, r.j): r.dist for r in knn.knn_graph(f, 3, "cosine").collect()}
    assert got[0, 1] == 0 and got[0, 2] == 1 and got[0, 3] == 1
    got = {(r.i, r.j): r.dist for r in knn.knn_graph(f, 3, "inner_product").collect()}
    assert got[0, 1] == -1 and got[0, 3] == 1


def test_ivf_recall(spark):
    x = np.random.default_rng(107).normal(size=(600, 24))
    f = frame(spark, x)
    c = knn.ivf_centroids(f)
    probes, recall = knn.tuned_probes(f, 20, c)
    got = {(r.i, r.j) for r in knn.ivf_join(f, f, 20, c, probes, exclude_self=True).collect()}
    want = {(i, j) for i, _, j, _ in brute(x, x, 20, True)}
    assert recall >= 0.99 and len(got & want) >= 0.98 * len(want) and all(i != j for i, j in got)


def test_grid_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 2)), rng.normal(50, 1, size=(100, 2)), np.zeros((30, 2)), [[500, -500]]])
    assert rows(spatial.grid_knn(frame(spark, x), 7)) == brute(x, x, 7, True)
    y = rng.random((200, 3))
    assert rows(spatial.grid_knn(frame(spark, y), 4, exclude_self=False)) == brute(y, y, 4, False)


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 1, 1, 0.0), (1, 2, 2, -1.0), (1, 3, 9, 1.0), (1, 4, 3, float("inf")), (1, 5, 3, 2.0), (2, 1, 1, float("nan")), (2, 2, 3, 5.0)], "i long, rank int, j long, dist double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(knn.normalize_graph(e, 5, nodes)) == [(1, 1, 2, 0.0), (1, 2, 3, 2.0), (2, 1, 3, 5.0)]
    assert rows(knn.induced(spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 1.0), (2, 1, 3, 1.0)], "i long, rank int, j long, dist double"), nodes.where("id <> 2"))) == [(1, 1, 3, 1.0)]
    a = spark.createDataFrame([(1, 1, 2, 9.0), (1, 2, 3, 9.0)], "i long, rank int, j long, dist double")
    b = spark.createDataFrame([(1, 1, 3, 9.0), (1, 2, 4, 9.0)], "i long, rank int, j long, dist double")
    assert rows(knn.interleave(a, b, 3)) == [(1, 1, 2, round(1 / 3, 9)), (1, 2, 3, round(1 / 3, 9)), (1, 3, 4, round(2 / 3, 9))]
    s = spark.createDataFrame([(1, 1, 1.0, 0), (1, 2, 0.2, 1), (1, 3, 0.9, 2), (1, 4, 0.9, 3), (2, 1, 7.0, 4)], "i long, j long, value double, pos long")
    assert rows(knn.import_sparse(s, 2, similarity=True)) == [(1, 1, 3, 0.1), (1, 2, 4, 0.1), (2, 1, 1, 0.0)]


@pytest.mark.parametrize("metric", knn.METRICS)
def test_products_of_matrices_find_the_exact_nearest(metric):
    rng = np.random.default_rng(5)
    tables = [rng.normal(size=(700, 9)), rng.integers(0, 2, size=(1500, 4)).astype(float), 1e7 + rng.normal(size=(500, 3)), np.vstack([rng.normal(size=(500, 3)), [[1e12] * 3]]), np.vstack([1e-6 * rng.normal(size=(1500, 3)), 5 + rng.normal(size=(9, 3))]), np.where(rng.random((400, 4)) < 0.01, np.nan, rng.normal(size=(400, 4)))]
    for x in tables:
        ids, ask = rng.permutation(len(x)) * 3, np.arange(0, len(x), 5)
        got = knn.Search(x[ask], ids[ask], x, ids, 6, metric, exclude_self=True).edges(lambda rows: [(None, 0, len(x))])
        y, want = knn._units(x) if metric == "cosine" else x, []
        for a in ask:
            d = knn._pair_distances(np.repeat(y[a : a + 1], len(y), axis=0), y, metric)
            d[a] = np.inf
            want += [(ids[a], ids[j], d[j]) for j in np.lexsort((ids, d))[:6] if np.isfinite(d[j])]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_a_pair_of_blocks_takes_seconds():
    import time

    import pandas as pd

    x = np.random.default_rng(6).normal(size=(8_192, 64))
    block = pd.DataFrame({"id": np.arange(len(x)), "vec": list(x), "part": 0})
    start = time.process_time()
    out = knn._nearest(15, "euclidean", True, False)((0, 0), block, block)
    assert len(out) == 15 * len(x) and time.process_time() - start < 12


def test_ivf_sends_a_query_once_a_block(spark, monkeypatch):
    """However many lists it looks into: rows sent to the join don't grow with the probes."""
    x = np.random.default_rng(8).normal(size=(900, 6)).round(1)
    f = frame(spark, x)
    c = knn.ivf_centroids(f)
    monkeypatch.setattr(knn, "BLOCK", 300)
    out = knn.ivf_join(f, f, 5, c, len(c), exclude_self=True)
    assert rows(out) == brute(x, x, 5, True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lists" in plan and plan.count("MapInPandas") == 1
    some = knn.ivf_join(f, f, 5, c, 3, exclude_self=True)
    lists = ((c**2).sum(axis=1)[None] - 2 * x @ c.T)
    own, near = lists.argmin(axis=1), np.argsort(lists, axis=1, kind="stable")[:, :3]
    want = []
    for i in range(len(x)):
        may = [j for j in range(len(x)) if j != i and own[j] in near[i]]
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in may)
        want += [(i, r + 1, j, round(v, 9)) for r, (v, j) in enumerate(d[:5])]
    assert rows(some) == want
