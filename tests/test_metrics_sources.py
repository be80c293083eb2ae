import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import knn
from tessera.operators import metrics as M
from tessera.sources import matrices


def labels(spark, truth, pred):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(truth, pred)], "truth long, pred long")


def test_perfect_and_independent_labelings(spark):
    same = labels(spark, [1, 1, 2, 2], [7, 7, 5, 5])
    assert M.rand_index(same).first().ari == 1 and M.information(same).first().purity == 1
    r = M.information(same).first()
    assert all(abs(v - 1) < 1e-12 for v in (r.nmi, r.nmi_sqrt, r.homogeneity, r.completeness, r.v_measure))
    free = labels(spark, [1, 1, 2, 2], [1, 2, 1, 2])
    assert abs(M.rand_index(free).first().ari + 0.5) < 1e-12 and abs(M.information(free).first().nmi) < 1e-12
    assert [(x.truth, x.pred) for x in M.class_scores(same).orderBy("truth").collect()] == [(1, 7), (2, 5)]


def test_alignment(spark):
    got = {r.pred: r.truth for r in M.align_labels(labels(spark, [1, 1, 1, 2, 2, 3], [9, 9, 8, 8, 8, 7])).collect()}
    assert got == {9: 1, 8: 2, 7: 3}


def test_independent_labels_share_nothing(spark):
    r = M.information(labels(spark, [1, 1, 2, 2], [1, 2, 1, 2])).first()
    assert r.v_measure == r.homogeneity == r.completeness == 0
    one = M.information(labels(spark, [1, 1, 1], [4, 4, 4])).first()
    assert one.nmi == one.v_measure == 1


def test_classes_meet_their_largest_overlap(spark):
    r = M.class_scores(labels(spark, [1] * 11 + [2] * 20, [7] * 6 + [8] * 5 + [7] * 20)).where("truth = 1").first()
    assert (r.pred, r.support) == (7, 11) and abs(r.recall - 6 / 11) < 1e-12 and abs(r.precision - 6 / 26) < 1e-12


def clouds(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, 3)), np.array([0] * (n // 2) + [1] * (n - n // 2 - 1) + [2])
    f = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, vec array<double>, label int")
    return x, y, f, np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def test_silhouette_against_pairs(spark, monkeypatch):
    x, y, f, d = clouds(spark)
    s = []
    for i in range(40):
        own = (y == y[i]) & (np.arange(40) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, y == c].mean() for c in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    for block in (4096, 7):
        monkeypatch.setattr(knn, "BLOCK", block)
        got = {r.label: r.silhouette for r in M.silhouette(f).collect()}
        assert abs(got[None] - np.mean(s)) < 1e-9 and got[2] == 0
        least = M.silhouette_summary(f, None).first()
        assert abs(least.silhouette_class_min - min(np.mean(np.array(s)[y == c]) for c in (0, 1, 2))) < 1e-9
    few = {r.label: r.n for r in M.silhouette(f, 10).collect()}
    assert few[None] == 10
    one = M.silhouette(f.withColumn("label", F.lit(1))).collect()
    assert all(r.silhouette is None for r in one)
    odd = f.union(spark.createDataFrame([(90, [float("nan")] * 3, 0), (91, None, 1), (92, [1.0, 2.0, 3.0], None), (93, [None, 1.0, 2.0], 1)], f.schema))
    assert {r.label: r.n for r in M.silhouette(odd).collect()} == {0: 20, 1: 19, 2: 1, None: 40}


def test_metrics_take_all_rows(spark, monkeypatch):
    """Beyond the numbers of rows and edges that samples had."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5_200, 2)).round(2), rng.integers(0, 3, 5_200)
    f = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, vec array<double>, label int").cache()
    assert {r.label: r.n for r in M.silhouette(f).collect()} == {**{c: int((y == c).sum()) for c in range(3)}, None: 5_200}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    same = y[:, None] == y[None]
    assert M.scatter(f).first().dunn == d[~same].min() / d[same].max() == 0
    apart = f.withColumn("vec", F.transform("vec", lambda v: v + 20 * F.col("label")))
    z = x + 20 * y[:, None]
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert np.isclose(M.scatter(apart).first().dunn, d[~same].min() / d[same].max(), rtol=1e-12)
    assert M.neighbor_purity(f, 5).first().n == 5_200
    ring = spark.range(130_000).select(F.col("id").alias("i"), ((F.col("id") + 1) % 130_000).alias("j"))
    runs = spark.range(130_000).select(F.lit(1).alias("run"), "id", (F.col("id") % 2).alias("label"))
    assert M.agreement_quantiles(ring, runs).first().edges == 130_000


def test_four_points(spark):
    """Two classes of two points each on a line: 0, 2 and 5, 9."""
    f = spark.createDataFrame([(1, [0.0], 0), (2, [2.0], 0), (3, [5.0], 1), (4, [9.0], 1)], "id long, vec array<double>, label int")
    r = M.scatter(f).first()
    assert np.allclose((r.within, r.between), (2 + 8, 2 * 9 + 2 * 9)) and np.isclose(r.dunn, 3 / 4) and np.isclose(r.separation_ratio, 3.6)
    assert np.isclose(r.davies_bouldin, (1 + 2) / 6) and np.isclose(r.calinski_harabasz, 36 / (10 / 2))
    c = {x.label: (x.rms, x.normalized_rms) for x in M.compactness(f).collect()}
    overall = np.sqrt(np.mean(np.square(np.array([0, 2, 5, 9]) - 4)))
    assert np.allclose(c[0], (1, 1 / overall)) and np.allclose(c[1], (2, 2 / overall)) and np.isclose(M.truth_compactness(f).first().compactness, 1.5 / overall)
    assert all(v is None for v in M.scatter(f.withColumn("label", F.col("id").cast("int"))).first())
    assert M.neighbor_purity(f, 1).first().purity == 0.75 and M.neighbor_purity(f, 3).first().purity is None  # 5 is nearer to 2 than to 9


def test_graph_metrics_by_hand(spark):
    e = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (3, 1, 4, -1.0), (4, 1, 1, 3.0), (4, 2, 4, 0.0)], "i long, rank int, j long, dist double")
    l = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "id long, label int")
    got = {r.label: r.conductance for r in M.conductance(e, l).collect()}  # volumes 2.5 and 1.25, cuts 0.5 and 0.25
    assert np.isclose(got[0], 0.5 / 1.25) and np.isclose(got[1], 0.25 / 1.25) and got[2] == 0
    assert np.isclose(M.conductance_summary(e, l).first().mean, (0.4 + 0.2) / 3)
    p = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1), (5, 2)], "id long, label int")
    r = M.boundary_f1(e, l, p).first()  # true: 1-3, 4-1; predicted: 1-2, 1-3, 2-1, 4-1
    assert np.isclose(r.precision, 0.5) and r.recall == 1 and np.isclose(r.f1, 2 / 3)
    runs = spark.createDataFrame([(m, i, v) for m, row in enumerate([[1, 1, 2, 2], [1, 2, 2, 2]], 1) for i, v in enumerate(row, 1)], "run int, id long, label long")
    q = M.agreement_quantiles(e, runs).first()  # 1-2 .5, 1-3 0, 2-1 .5, 3-4 1, 4-1 0
    assert (q.edges, q.q0, q.q50, q.q100) == (5, 0, 0.5, 1) and np.isclose(q.q25, 0)
    a = {r.prefix: r for r in M.prefix_agreement(e, runs).collect()}
    assert set(a) == {2} and np.isclose(a[2].mean_agreement, 0.4) and np.isclose(a[2].sd_agreement, np.std([0.5, 0, 0.5, 1, 0], ddof=1))


def test_binary_sources(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(37, 4)).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(float))], "id long, vec array<double>")
    matrices.write_raw(rows.repartition(3), f"{tmp_path}/blobs")
    back = sorted((r.id, r.vec) for r in matrices.read_blobs(spark, f"{tmp_path}/blobs").collect())
    assert np.allclose([v for _, v in back], x) and [i for i, _ in back] == list(range(37))
    (tmp_path / "raw").mkdir()
    x[:20].astype("float64").tofile(tmp_path / "raw/a.bin")
    x[20:].astype("float64").tofile(tmp_path / "raw/b.bin")
    back = sorted((r.id, r.vec) for r in matrices.read_raw(spark, f"{tmp_path}/raw", 4).collect())
    assert np.allclose([v for _, v in back], x) and [i for i, _ in back] == list(range(37))
    np.savez(tmp_path / "m.npz", data=x)
    assert np.allclose([r.vec for r in matrices.read_npz(spark, f"{tmp_path}/m.npz").orderBy("id").collect()], x)
    rows.write.parquet(f"{tmp_path}/m.parquet")
    m = matrices.read_matrix(spark, f"{tmp_path}/m.parquet", {"id": "id", "x": "vec[0]"})
    assert m.columns == ["id", "x"] and np.allclose([r.vec for r in matrices.transpose(rows).orderBy("id").collect()], x.T)


@pytest.mark.parametrize("kind, dims", [("dini", 3), ("helicoid", 3), ("spirals", 2), ("swiss_roll", 3)])
def test_manifolds(spark, kind, dims):
    got = np.array([r.vec for r in matrices.manifold(spark, kind, 100).collect()])
    assert got.shape == (100, dims) and np.isfinite(got).all()
    if kind == "helicoid":
        r, u = np.hypot(got[:, 0], got[:, 1]), got[:, 2]
        assert np.allclose(np.abs(got[:, 0] * np.sin(u)), np.abs(got[:, 1] * np.cos(u)), atol=1e-9) and r.max() <= 1
    with pytest.raises(ValueError):
        matrices.manifold(spark, "plane", 3)


def test_cells_are_numbered_by_place_beyond_five_digits(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    path = f"{tmp_path}/embeddings.parquet"
    spark.range(99_995, 100_006).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda c: (c * F.col("id") / 1000).cast("float")).alias("embedding"), F.lit(0).alias("label")).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(entry.oracle_sql()["s8_single_cell_reduction"]).fetchall()
    got = [tuple(r) for r in entry.queries()["s8_single_cell_reduction"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (4, "c99999") in {r[:2] for r in got} and (5, "c100000") in {r[:2] for r in got}
