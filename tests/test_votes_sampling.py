import collections

import numpy as np
import pytest

from tessera.operators import sampling as S
from tessera.operators import votes as V


def test_fallback_of_other_folds(spark):
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "id long, label long")
    folds = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, fold int")
    none = spark.createDataFrame([], "i long, rank int, j long, dist double")
    assert [r.pred for r in V.predict(none, labels, folds).orderBy("id").collect()] == [2, 1, 1]


def test_confusion_drops_unknown_predictions(spark):
    rows = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "truth long, pred long")
    assert sorted(tuple(r) for r in V.confusion(rows).collect()) == [(1, 1, 1), (2, 2, 1)]


def test_votes_break_ties_by_score_then_label(spark):
    n = spark.createDataFrame([(1, 5, 0.1), (1, 3, 0.2), (2, 5, 0.1), (2, 3, 0.1), (3, 7, 0.0), (3, 7, 0.0), (3, 1, 9.0)], "id long, label long, score double")
    assert {r.id: r.label for r in V.vote(n).collect()} == {1: 3, 2: 3, 3: 7}
    assert V.majority(n.drop("score"), "id").where("id = 1").first().label == 3


def test_knn_cv_of_a_clear_signal(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x = rng.normal(-0.5, 0.25, 6)
        x[[i % 3, i % 3 + 3]] += 3
        rows.append((i, x.tolist(), 10 + i % 3))
    f = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    out = V.knn_cv(f, S.folds(f, 10), 10)
    assert V.accuracy(out).first().accuracy > 0.95 and out.count() == 150


def test_folds(spark):
    rows = spark.createDataFrame([(i, i % 4, i // 2) for i in range(200)], "id long, label long, grp long")
    by = collections.Counter((r.label, r.fold) for r in S.folds(rows, 5).join(rows, "id").collect())
    assert set(by.values()) == {10}
    plain = collections.Counter(r.fold for r in S.folds(rows, 7, stratified=False).collect())
    assert max(plain.values()) - min(plain.values()) <= 1
    for strat in (True, False):
        g = S.grouped_folds(rows, 5, 1, strat).join(rows, "id").collect()
        assert len({(r.grp, r.fold) for r in g}) == 100 and set(collections.Counter(r.fold for r in g).values()) == {40}
    with pytest.raises(ValueError):
        S.folds(rows, 1)
    assert {(r.id, r.fold) for r in S.folds(rows, 5).collect()} == {(r.id, r.fold) for r in S.folds(rows.repartition(7), 5).collect()}


def test_landmarks_meet_the_quota(spark):
    rows = spark.createDataFrame([(i, 0 if i < 70 else 1 if i < 95 else 2) for i in range(100)], "id long, stratum long")
    for target in (1, 10, 33, 99, 100, 500):
        got = S.landmarks(rows, target).collect()
        n = collections.Counter(r.stratum for r in got)
        assert len(got) == min(100, target) and all(abs(n[k] - min(target, 100) * s / 100) < 1 for k, s in ((0, 70), (1, 25), (2, 5)))


def test_every_group_gets_a_landmark(spark):
    rows = spark.createDataFrame([(i, i // 10) for i in range(100)], "id long, grp long")
    got = S.covered_landmarks(rows, rows.where("grp < 3").select("id")).collect()
    assert len(got) == 30 and {r.id // 10 for r in got} == set(range(10))
    with pytest.raises(ValueError):
        S.covered_landmarks(rows, rows.limit(5).select("id"))


def test_bh(spark):
    p = [0.01, 0.04, 0.03]
    got = {r.id: r.q for r in S.adjust_bh(spark.createDataFrame(list(enumerate(p)), "id long, p double")).collect()}
    assert np.allclose([got[i] for i in range(3)], [0.03, 0.04, 0.04])
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(200) ** 4, [0.5] * 20, [1.0, 0.0]])
    order = np.argsort(-p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1)))
    got = {r.id: r.q for r in S.adjust_bh(spark.createDataFrame(list(enumerate(map(float, p))), "id long, p double")).collect()}
    assert np.allclose([got[i] for i in range(len(p))], want)


def test_objective_and_absorption(spark):
    one = spark.createDataFrame([(1, 1)] * 4, "truth long, pred long")
    assert V.objective(one).first().guarded is None
    two = V.objective(spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 1)], "truth long, pred long")).first()
    assert abs(two.guarded - 0.75 * 0.5**0.5) < 1e-12
    moves = spark.createDataFrame([(1, 2)] * 5 + [(1, 1)] * 2 + [(2, 2)] * 7 + [(3, 3)] * 6, "label long, pred long")
    assert [tuple(r)[:3] for r in V.absorption_candidates(moves).collect()] == [(1, 2, 5)]
