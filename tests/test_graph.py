import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed, ensemble, graph
from tessera.operators.knn import knn_graph

TRIANGLES = [(1, 2, 0.10), (1, 3, 0.11), (2, 1, 0.10), (2, 3, 0.12), (3, 1, 0.11), (3, 2, 0.12), (4, 5, 0.20), (4, 6, 0.21), (5, 4, 0.20), (5, 6, 0.19), (6, 5, 0.19), (6, 4, 0.21)]


def triangles(spark):
    rank = {}
    rows = []
    for i, j, d in sorted(TRIANGLES, key=lambda e: (e[0], e[2])):
        rank[i] = rank.get(i, 0) + 1
        rows.append((i, rank[i], j, d))
    return spark.createDataFrame(rows, "i long, rank int, j long, dist double"), spark.createDataFrame([(i,) for i in range(1, 7)], "id long")


@pytest.mark.parametrize("weight", graph.WEIGHTS)
def test_two_triangles(spark, weight):
    e, nodes = triangles(spark)
    got = {r.id: r.cluster for r in graph.cluster_graph(e, nodes, weight).collect()}
    assert len(set(got.values())) == 2 and got[1] == got[2] == got[3] != got[4] == got[5] == got[6]
    assert len({r.cluster for r in graph.cluster_graph(e, nodes, weight, target=3).collect()}) == 3


def test_cluster_errors_and_pruning(spark):
    e, nodes = triangles(spark)
    for k in (1, 7):
        with pytest.raises(ValueError):
            graph.cluster_graph(e, nodes, target=k)
    assert len({r.cluster for r in graph.cluster_graph(e, nodes, "binary", prune=1.0).collect()}) == 6
    assert graph.weigh(e, "binary", 1.0).count() == 0


def test_clustering_of_an_embedding(spark):
    x = [(0, 0), (0.1, 0), (0, 0.1), (5, 5), (5.1, 5), (5, 5.1)]
    f = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(x)], "id long, vec array<double>")
    got = {r.id: r.cluster for r in graph.cluster_graph(knn_graph(f, 2), f, target=2).collect()}
    assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5]


def test_components_of_paths_and_isolated_nodes(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 100], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)] + [(999,)], "id long")
    got = {r.id: r.component for r in graph.components(e, nodes).collect()}
    want, c = {999: 999}, 0
    for i in range(n + 1):
        if i == 0 or (i - 1) % 100 == 0:
            c = i
        want[i] = c
    assert got == want


def test_dissimilarity_by_hand(spark):
    g = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.7)], "i long, rank int, j long, dist double")
    lab = spark.createDataFrame([(r, i, x) for i, xs in ((1, [1, 2, 0, 3]), (2, [1, 9, 4, 3]), (3, [5, 5, 5, 5])) for r, x in enumerate(xs)], "run int, id long, label long")
    got = {r.j: (r["rank"], r.dist, r.valid, r.same) for r in ensemble.dissimilarity(g, lab).collect()}
    assert abs(got[2][1] - 3.375) < 1e-12 and got[2][2:] == (3, 2) and got[3] == (2, float("inf"), 3, 0)


def test_spanning_forest(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(29)], "a long, b long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(30)], "id long")
    assert len({r.component for r in graph.spanning_components(e, nodes, 4).collect()}) == 4
    sizes = {}
    for r in graph.balanced_regions(e, nodes, 0.2).collect():
        sizes.setdefault(r.region, set()).add(r.id)
    assert all(len(s) >= 5 and max(s) - min(s) == len(s) - 1 for s in sizes.values()) and len(sizes) > 2


def test_binary_union(spark):
    ring = [(i, k + 1, j, 1.0) for i in range(6) for k, j in enumerate([(i + 1) % 6, (i - 1) % 6, (i + 1) % 6, i])]
    g = spark.createDataFrame(ring, "i long, rank int, j long, dist double")
    out = graph.binary_union(g).collect()
    assert len(out) == 12 and max(r.w for r in out) == 1
    with pytest.raises(ValueError):
        graph.binary_union(g.where("i = j"))


def test_project_labels(spark):
    g = spark.createDataFrame([(3, 1, 1, 0.1), (3, 2, 2, 0.2), (4, 1, 3, 0.1), (5, 1, 6, 0.1)], "i long, rank int, j long, dist double")
    known = spark.createDataFrame([(1, 7), (2, 8), (9, 8)], "id long, label long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 9)], "id long")
    assert {r.id: r.label for r in ensemble.project_labels(g, known, nodes, 5).collect()} == {3: 7, 4: 7, 5: 8, 6: 8}


def test_modularity_of_triangles(spark):
    e, nodes = triangles(spark)
    w = graph.weigh(e, "binary")
    lab = spark.createDataFrame([(i, i // 4) for i in range(1, 7)], "id long, label long")
    assert abs(graph.modularity(w, lab).first()[0] - 0.5) < 1e-12


def test_affinities_and_layouts(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, (40, 5)), rng.normal(4, 0.2, (40, 5))])
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    g = knn_graph(f, 20)
    p = embed.affinities(g, 10.0)
    assert abs(2 * sum(r.w for r in p.collect()) - 1) < 1e-9
    from tessera.operators import linalg

    start = linalg.starting_layout(linalg.pca(f, 2)[0], "opentsne")
    y = {r.id: np.array(r.vec) for r in embed.tsne_layout(p, start, 10.0, (60, 12.0), 60).collect()}
    c = [np.mean([y[i] for i in s], axis=0) for s in (range(40), range(40, 80))]
    assert all(np.linalg.norm(y[i] - c[i // 40]) < np.linalg.norm(y[i] - c[1 - i // 40]) for i in range(80))
    fz = embed.fuzzy_graph(knn_graph(f, 10))
    assert all(0 < r.w <= 1 for r in fz.collect())
    u = {r.id: np.array(r.vec) for r in embed.umap_layout(fz, embed.spectral_start(fz, f)).collect()}
    again = {r.id: np.array(r.vec) for r in embed.umap_layout(fz, embed.spectral_start(fz, f)).collect()}
    assert all(np.array_equal(u[i], again[i]) and np.isfinite(u[i]).all() for i in u)
    c = [np.mean([u[i] for i in s], axis=0) for s in (range(40), range(40, 80))]
    assert np.linalg.norm(c[0] - c[1]) > 2 * np.mean([np.linalg.norm(u[i] - c[i // 40]) for i in range(80)])
    with pytest.raises(ValueError):
        embed.tsne_layout(p, start, 30.0)


@pytest.mark.parametrize("spread", [1e-4, 1.0, 30.0, 60.0])
def test_repulsion_by_a_grid_against_all_pairs(spread):
    rng = np.random.default_rng(2)
    y = spread * np.concatenate([rng.normal(size=(700, 2)), 0.05 * rng.normal(size=(700, 2)) + 1])
    (z, away), (want_z, want) = embed.Repulsion()(y), embed._paired(y)
    assert abs(z / want_z - 1) < 0.01 and np.linalg.norm(away - want) < 0.02 * np.linalg.norm(want)


def test_layouts_of_more_points_than_pairs_allow(spark):
    """Beyond 5,000 points t-SNE raised TooLarge, beyond 20,000 UMAP and the spectral start did."""
    n = 20_100
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"))
    e = ring.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.lit(0.5 / n).alias("w"))
    start = spark.range(n).select("id", F.array(F.cos(2 * np.pi * F.col("id") / n), F.sin(2 * np.pi * F.col("id") / n)).alias("vec"))
    for y in (embed.tsne_layout(e, start, 10.0, (3, 12.0), 3), embed.umap_layout(e, start, epochs=2), embed.spectral_start(e, start)):
        y = np.array([r.vec for r in y.collect()])
        assert y.shape == (n, 2) and np.isfinite(y).all()


def test_shortest_tree_against_all_distances():
    """Also with many equal distances, as a table of all of them gave it."""
    for x in (np.random.default_rng(1).normal(size=(60, 3)), np.random.default_rng(1).integers(0, 4, (50, 2)).astype(float)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        joined, want = [0], []
        while len(joined) < len(x):
            sub = d[joined].copy()
            sub[:, joined] = np.inf
            k, j = np.unravel_index(int(np.argmin(sub)), sub.shape)
            want.append((joined[k], int(j)))
            joined.append(int(j))
        assert graph._shortest_tree(x) == want


def test_more_than_five_thousand_components_are_bridged(spark):
    n = 10_400
    rows = spark.range(n).select("id", F.array(F.expr("id div 2").cast("double"), F.lit(0.0)).alias("vec"))
    e = rows.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    got = {(r.a, r.b) for r in graph.bridged(e, rows, rows).collect()}
    assert got == {(i, i + 1) for i in range(0, n, 2)} | {(i, i + 2) for i in range(0, n - 2, 2)}


def test_sparse_walks_give_the_clusters_of_dense_ones(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1, (60, 3)) for c in (0, 4, 8)])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = np.argsort(d, axis=1)[:, 1:8]
    e = sorted({(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in near[i]})
    a, b = np.array(e).T
    w = 1 / (1 + np.sqrt(d[a, b]))
    for target in (0, 5):
        dense = graph.walk_clusters(len(x), a, b, w, 4, target)
        with monkeypatch.context() as m:
            m.setattr(graph, "MOST_DENSE", 10)
            assert np.array_equal(graph.walk_clusters(len(x), a, b, w, 4, target), dense)


def test_more_than_four_thousand_rows_are_clustered(spark):
    """Pairs of rows, more of them than walks took."""
    n = 4_200
    nodes = spark.range(n)
    e = nodes.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    got = {r.id: r.cluster for r in graph.walktrap(e, nodes).collect()}
    assert len(got) == n and all(got[i] == got[i + 1] for i in range(0, n, 2)) and len(set(got.values())) == n // 2


def test_laplacian_features_against_numpy(spark):
    """Power iterations of the dense normalised matrix from the same hashed normal numbers span the same features."""
    rng = np.random.default_rng(4)
    n, dims, steps = 40, 3, 5
    x = rng.normal(size=(n, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    order = np.argsort(d, axis=1)[:, 1:7]
    edges = spark.createDataFrame([(i, r + 1, int(j), float(d[i, j])) for i in range(n) for r, j in enumerate(order[i])], "i long, rank int, j long, dist double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = np.array([r.vec for r in graph.laplacian_features(edges, nodes, dims, steps).orderBy("id").collect()])
    s = np.array([np.sort(d[i, order[i]])[3] for i in range(n)])
    w = np.zeros((n, n))
    for i in range(n):
        for j in order[i]:
            w[i, j] = w[j, i] = np.exp(-(d[i, j] ** 2) / (s[i] * s[j]))
    w /= np.sqrt(np.outer(w.sum(axis=1), w.sum(axis=1)))
    unit = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52
    y = np.array([[np.sqrt(-2 * np.log(1 - unit(1234, i, f"r{c}"))) * np.cos(2 * np.pi * unit(1234, i, f"a{c}")) for c in range(dims)] for i in range(n)])
    for _ in range(steps):
        y = w @ np.linalg.qr(y)[0]
    basis = np.linalg.qr(y)[0]
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9) and np.allclose(got.std(axis=0, ddof=1), 1)
    both = np.concatenate([basis, np.ones((n, 1))], axis=1)  # features are centred combinations of the basis
    fit = both @ np.linalg.lstsq(both, got, rcond=None)[0]
    assert np.allclose(fit, got, atol=1e-6)
