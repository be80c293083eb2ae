import math

import numpy as np
import pytest

from tessera.operators import spatial as S
from tessera.operators.stats import assignment, beta_tail


def slides(spark, x, samples):
    return spark.createDataFrame([(i, int(s), [float(a) for a in p]) for i, (p, s) in enumerate(zip(x, samples))], "id long, sample int, vec array<double>")


def test_slides_lie_side_by_side(spark):
    got = [tuple(r.vec) for r in S.separate_samples(slides(spark, [(0, 0), (2, 1)] * 2, [1, 1, 2, 2])).orderBy("id").collect()]
    assert got == [(0, 0), (2, 1), (3, 0), (5, 1)]
    one = slides(spark, [(0, 0), (2, 1)], [1, 1])
    assert [tuple(r.vec) for r in S.separate_samples(one).orderBy("id").collect()] == [(0, 0), (2, 1)]


def passed(x, data, samples, k):
    out = np.zeros_like(data)
    for s in set(samples):
        own = [i for i, t in enumerate(samples) if t == s]
        near = {i: sorted((math.dist(x[i], x[j]), j) for j in own)[:k] for i in own}
        top = max(d for v in near.values() for d, _ in v)
        for i in own:
            for d, j in near[i]:
                out[i] += math.exp(-d / top if top > 0 else 0) * data[j]
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_message_passing(spark, k):
    x = [(0, 0), (1, 0), (3, 0), (7, 0)] * 2
    data = np.arange(24.0).reshape(8, 3)
    samples = [11] * 4 + [29] * 4
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>")
    got = np.array([r.vec for r in S.pass_messages(slides(spark, x, samples), f, k).orderBy("id").collect()])
    assert np.allclose(got, passed(x, data, samples, k), atol=2e-6)
    if k == 1:
        assert np.allclose(got, data)
    with pytest.raises(ValueError):
        S.pass_messages(slides(spark, x, samples), f, 5)


def test_message_passing_closed_form(spark):
    data = np.array([(1, 2), (2, 1), (4, 3), (10, 20), (20, 10), (40, 30)], float)
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>")
    got = np.array([r.vec for r in S.pass_messages(slides(spark, [(0, 0), (1, 0), (3, 0)] * 2, [1] * 3 + [2] * 3), f, 2).orderBy("id").collect()])
    for o in (0, 3):
        want = [data[o] + data[o + 1] * math.exp(-0.5), data[o + 1] + data[o] * math.exp(-0.5), data[o + 2] + data[o + 1] * math.exp(-1)]
        assert np.allclose(got[o : o + 3], want)


def test_jitter_is_replayed_and_bounded(spark):
    p = slides(spark, [(0, 0)] * 50, [1] * 50).drop("sample")
    w = spark.createDataFrame([(0, 0.5), (1, 0.1)], "c int, width double")
    a = {r.id: r.vec for r in S.jitter(p, w, 3).collect()}
    assert a == {r.id: r.vec for r in S.jitter(p.repartition(7), w, 3).collect()} != {r.id: r.vec for r in S.jitter(p, w, 4).collect()}
    assert all(abs(x) <= 0.5 and abs(y) <= 0.1 for x, y in a.values()) and len({tuple(v) for v in a.values()}) == 50


def test_singletons_join_a_neighbour_of_their_sample(spark):
    rows = slides(spark, [(0, 0), (1, 0), (9, 0), (8, 0), (0.2, 0)], [1, 1, 1, 1, 2])
    rows = rows.join(spark.createDataFrame([(0, 5), (1, 5), (2, 6), (3, 7), (4, 8)], "id long, cluster long"), "id")
    more = rows.union(spark.createDataFrame([(10, 2, [9.0, 9.0], 9), (11, 2, [9.0, 8.0], 9)], rows.schema))
    got = {r.id: r.cluster for r in S.repair_singletons(more).collect()}
    assert got == {0: 5, 1: 5, 2: 5, 3: 5, 4: 9, 10: 9, 11: 9}


def test_population_coordinates(spark):
    x = [(i % 6, i % 2) for i in range(60)]
    p = slides(spark, x, [1] * 60).drop("sample")
    a = {r.id: tuple(r.vec) for r in S.regularize_population(p).collect()}
    assert a == {r.id: tuple(r.vec) for r in S.regularize_population(p).collect()}
    assert len(set(a.values())) == 6 and all(a[i] == a[i + 6] for i in range(54)) and np.isfinite(list(a.values())).all()
    with pytest.raises(ValueError):
        S.regularize_population(slides(spark, [(0, 0, 0), (1, 1, 1)], [1, 1]).drop("sample"))
    with pytest.raises(ValueError):
        S.regularize_population(slides(spark, [(0, 0), (0, 0)], [1, 1]).drop("sample"))


def test_screening_finds_spatial_features(spark):
    rng = np.random.default_rng(2026)
    x = rng.random((240, 2))
    v = rng.normal(size=(240, 24))
    v[:, 0], v[:, 1] = x[:, 0] + 0.05 * v[:, 0], np.sin(3 * x[:, 0]) + 0.05 * v[:, 1]
    v[:, 5] = 0
    rows = spark.createDataFrame([(i, i % 2, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, v))], "id long, sample long, x array<double>, vec array<double>")
    got = {r.c: r for r in S.screen_features(rows).collect()}
    assert {c for c, r in got.items() if r["rank"] <= 2} == {0, 1} and got[0].p < 1e-4 and got[1].p < 1e-4
    assert got[5].p == 1 and got[5].score == 0 and all(0 <= r.q <= 1 and r.q >= r.p - 1e-15 for r in got.values())
    with pytest.raises(ValueError):
        S.screen_features(rows.limit(5))


def test_beta_function():
    for a, b, x, want in ((1, 1, 0.3, 0.3), (2, 3, 0.4, 0.5248), (0.5, 0.5, 0.5, 0.5), (10, 2, 0.9, 0.6973568802)):
        assert abs(beta_tail(x, a, b) - want) < 1e-9
    assert beta_tail(0, 2, 2) == 0 and beta_tail(1, 2, 2) == 1


def test_assignment():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = rng.integers(1, 5), 5
        cost = rng.integers(0, 20, (n, m)).astype(float)
        got = assignment(cost)
        assert len(set(got)) == n and cost[range(n), got].sum() == min(cost[range(n), p].sum() for p in itertools.permutations(range(m), int(n)))


@pytest.mark.parametrize("dims, n, k", [(1, 60, 4), (2, 300, 7), (3, 200, 5), (2, 3, 10)])
def test_grid_knn_equals_all_pairs(spark, dims, n, k):
    """Clouds, far rows, equal points and a line, in samples of very different sizes."""
    rng = np.random.default_rng(dims * 10 + n)
    x = rng.normal(size=(n, dims))
    x[: n // 4] *= 1e-3
    x[n // 4 : n // 3] += 50.0
    x[n // 3 : n // 2] = x[n // 3]
    x[-1] = 1e4
    sample = np.where(np.arange(n) % 10 == 0, 1, 0)
    rows = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(sample, x))], "id long, sample int, vec array<double>")
    got = {}
    for r in S.grid_knn(rows, k).collect():
        got.setdefault(r.i, []).append((r["rank"], r.j, r.dist))
    for i in range(n):
        d = sorted((float(np.sqrt(np.square(x[i] - x[j]).sum())), j) for j in range(n) if j != i and sample[j] == sample[i])[:k]
        own = sorted(got.get(i, []))
        assert [j for _, j, _ in own] == [j for _, j in d] and np.allclose([e for *_, e in own], [e for e, _ in d])


def test_grid_knn_of_no_rows(spark):
    assert S.grid_knn(spark.createDataFrame([], "id long, vec array<double>"), 3).collect() == []
