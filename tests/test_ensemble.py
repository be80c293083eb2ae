import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ensemble, metrics, optimizer
from tessera.session import TooLarge


def signal(n=150):
    rng = np.random.default_rng(0)
    y = np.arange(n) % 3
    x = rng.normal(-0.5, 0.25, (n, 6))
    x[np.arange(n), y] += 3
    x[np.arange(n), y + 3] += 3
    return x, y


def neighbours(x, fold, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d[fold[:, None] == fold[None]] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, -np.square(np.take_along_axis(d, near, 1))


@pytest.mark.parametrize("more", [{}, {"evolutionary": True, "diversity": True, "absorption": True}])
def test_optimizer_invariants(more):
    x, y = signal()
    fold = np.arange(150) // 2 % 10
    near, score = neighbours(x, fold, 10)
    start = np.where(np.arange(150) % 11 == 0, (y + 1) % 3, y) + 1
    groups, fixed = np.arange(150) // 2 // 3 * 3 + y, np.arange(150) < 12
    start = np.array([start[groups == g][0] for g in groups])
    o = optimizer.Options(cycles=40, k=10, **more)
    calls = []
    inner = optimizer.knn_predictor(near, score, fold)
    predict = lambda cl: (calls.append(1), inner(cl))[1]
    first = float((inner(start) == start).mean())
    a = optimizer.maximize(predict, start, groups, fixed, o)
    assert a.evaluations == len(calls) == 41 and len(a.trace) == 40
    assert all(p <= q for p, q in zip(a.scores, a.scores[1:])) and a.score >= optimizer.objective_score(start, first, o)
    assert (a.labels[fixed] == start[fixed]).all()
    free = ~fixed
    assert all(len(set(a.labels[(groups == g) & free])) <= 1 for g in set(groups))
    b = optimizer.maximize(inner, start, groups, fixed, o)
    assert np.array_equal(a.labels, b.labels) and a.trace == b.trace


def test_predictor_falls_back_to_other_folds():
    predict = optimizer.knn_predictor(np.full((3, 1), -1), np.zeros((3, 1)), np.array([0, 1, 2]))
    assert predict(np.array([1, 2, 2])).tolist() == [2, 1, 1]


def test_one_class_scores_worst_when_diversity_counts():
    o = optimizer.Options(diversity=True)
    assert optimizer.objective_score(np.ones(5), 1.0, o) == -np.inf
    assert abs(optimizer.objective_score(np.array([1, 1, 2, 2]), 0.5, o) - 0.5 * 0.5**0.5) < 1e-12
    both = optimizer.Options(diversity=True, coarsening=True, classifier="pls-lda")
    assert optimizer.objective_score(np.ones(50), 1.0, both) == -np.inf
    two, many = np.repeat([1, 2], 25), np.arange(50)
    assert abs(optimizer.objective_score(two, 0.9, both) - (0.9 * 0.5**0.5 - 0.1 * np.log(2) / np.log(50))) < 1e-12
    assert optimizer.objective_score(two, 0.9, both) > optimizer.objective_score(many, 0.2, both) > -np.inf
    plain = optimizer.Options(coarsening=True, classifier="pls-lda")
    assert abs(optimizer.objective_score(two, 0.9, plain) - (0.9 - 0.1 * np.log(2) / np.log(50))) < 1e-12
    assert optimizer.objective_score(np.ones(50), 0.7, plain) == 0.7  # nothing is split
    assert optimizer.objective_score(np.empty(0), 0.3, both) == 0.3


def test_one_class_never_wins():
    x, y = signal(90)
    fold = np.arange(90) % 5
    predict = optimizer.plslda_predictor(x, fold, 3)
    o = optimizer.Options(cycles=25, evolutionary=True, diversity=True, absorption=True, coarsening=True, classifier="pls-lda", folds=5)
    found = optimizer.maximize(predict, np.arange(90) % 12, np.arange(90), np.zeros(90, bool), o)
    assert len(np.unique(found.labels)) > 1 and np.isfinite(found.score) and len(found.cycles) == 25
    assert all(classes > 1 and size >= 1 and accepted == (up or warm) and not (up and warm) for size, classes, accepted, up, warm in found.cycles)
    assert sum(c[2] for c in found.cycles) == found.accepted


def test_merges_leave_fixed_rows_and_two_classes():
    rng = np.random.default_rng(0)
    labels = np.repeat([1, 2, 3, 4], 10)
    predicted = np.where(labels == 1, 2, np.where(labels == 3, 2, labels))
    fixed = np.zeros(40, bool)
    fixed[0] = True
    moved = optimizer.absorb(labels, predicted, fixed, rng)
    assert moved is None or (moved[0] == 1 and len(set(moved)) < 4)
    assert optimizer.absorb(np.array([1, 1, 2, 2]), np.array([2, 2, 2, 2]), np.zeros(4, bool), rng) is None
    assert optimizer.absorb(labels, labels, fixed, rng) is None


def test_ensemble(spark):
    x, y = signal(90)
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    groups = spark.createDataFrame([(i, i // 3 // 2 * 3 + i % 3) for i in range(90)], "id long, grp long")
    labels, trace, graph = ensemble.run_ensemble(f, runs=2, cycles=6, splitting=9, neighbours=15, k=8, constrain=groups)
    lab = labels.join(groups, "id").collect()
    assert len(lab) == 180 and len({(r.run, r.grp) for r in lab}) == len({(r.run, r.grp, r.label) for r in lab})
    summary = metrics.fit_summary(labels, trace).first()
    assert summary.cv_evaluations == 2 * 7 and 0 <= summary.cv_min <= summary.cv_mean <= summary.cv_max <= 1 and summary.classes_mean > 1
    assert metrics.cycle_deciles(trace).agg({"cycles": "sum"}).first()[0] == 12 and trace.where("accepted <> (improving or temperature)").isEmpty()
    d = graph.where("same > 0").collect()
    assert all(r.dist >= 1 for r in d) and np.mean([y[r.i] == y[r.j] for r in d]) > 0.95
    again = ensemble.run_ensemble(f.repartition(5), runs=2, cycles=6, splitting=9, neighbours=15, k=8, constrain=groups)[0]
    assert {(r.run, r.id, r.label) for r in lab} == {(r.run, r.id, r.label) for r in again.collect()}
    with pytest.raises(ValueError):
        ensemble.run_ensemble(f.limit(2))


def test_kernels_check_their_size(spark):
    rows = spark.createDataFrame([(1, i, 1, i, False, 0) for i in range(30)], "run int, id long, label long, grp long, fixed boolean, fold int")
    none = spark.createDataFrame([], "run int, i long, rank int, j long, dist double")
    with pytest.raises(TooLarge):
        optimizer.optimize(rows, none, optimizer.Options(), most=20)


@pytest.mark.parametrize("classifier", ["knn", "pls-lda"])
def test_a_run_of_more_than_fifty_thousand_rows(spark, classifier):
    vec = F.array(*(F.rand(c) + (F.col("id") % 2) for c in range(2)))
    rows = spark.range(50_500).select(F.lit(1).alias("run"), "id", (F.col("id") % 4).alias("label"), F.col("id").alias("grp"), F.lit(False).alias("fixed"), (F.col("id") % 5).cast("int").alias("fold"), vec.alias("vec"))
    near = spark.range(50_500).select(F.lit(1).alias("run"), F.col("id").alias("i"), F.lit(1).alias("rank"), ((F.col("id") + 1) % 50_500).alias("j"), F.lit(1.0).alias("dist"))
    found = optimizer.optimize(rows, near, optimizer.Options(cycles=1, classifier=classifier, components=2))
    assert found.where("best").count() == 50_500 and found.where("not best").count() == 1


@pytest.mark.parametrize("mode", [0, 1, -1])
def test_spatial_groups_stay_in_their_sample(spark, mode):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(i, i % 2, rng.random(2).tolist()) for i in range(90)], "id long, sample int, vec array<double>")
    got = {r.id: r.grp for r in ensemble.spatial_groups(p, 12, 0.2, mode).collect()}
    sizes = {}
    for i, g in got.items():
        sizes.setdefault(g, set()).add(i)
    assert len(got) == 90 and all(len({i % 2 for i in s}) == 1 and len(s) > 1 for s in sizes.values())
    constrain = spark.createDataFrame([(i, i // 4) for i in range(90)], "id long, grp long")
    tied = {r.id: r.grp for r in ensemble.spatial_groups(p, 12, 0.2, mode, constrain=constrain).collect()}
    assert all(tied[i] == tied[j] for i in range(90) for j in range(i) if i // 4 == j // 4 and i % 2 == j % 2)
