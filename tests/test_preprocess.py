import math

import numpy as np
import pytest

from tessera.operators import preprocess as P

TRAIN = [[1, 2, 3], [2, 4, 8], [4, 1, 5], [3, 6, 9]]
TEST = [[2, 3, 4], [5, 2, 1]]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<double>")


def parts(df, part):
    return [r for r in sorted(df.collect(), key=lambda r: r.id) if r.part == part]


@pytest.mark.parametrize(
    "method, coefs",
    [("pqn", [6, 12.9230769231, 10, 18]), ("sum", [6, 14, 10, 18]), ("median", [2, 4, 4, 6]), ("sqrt", [3.7416573868, 9.1651513899, 6.4807406984, 11.2249721603]), ("none", [1, 1, 1, 1])],
)
def test_normalization_coefficients(spark, method, coefs):
    out = P.normalize(frame(spark, TRAIN), method, frame(spark, TEST))
    train = parts(out, "train")
    assert np.allclose([r.coef for r in train], coefs, atol=2e-5)
    assert np.allclose([np.array(r.vec) * r.coef for r in train], TRAIN, atol=2e-6)
    assert np.allclose([np.array(r.vec) * r.coef for r in parts(out, "test")], TEST, atol=2e-6)


def test_sum_is_signed_on_train_only(spark):
    out = P.normalize(frame(spark, [[-2, 1], [2, 2]]), "sum", frame(spark, [[-2, 1]]))
    assert parts(out, "train")[0].coef == -1 and parts(out, "test")[0].coef == 3


@pytest.mark.parametrize("method", ["sum", "median", "sqrt"])
def test_missing_values_spoil_train_only(spark, method):
    out = P.normalize(frame(spark, [[1, math.nan, 3], [2, 4, 6]]), method, frame(spark, [[1, math.nan, 3]]))
    assert math.isnan(parts(out, "train")[0].coef) and math.isfinite(parts(out, "test")[0].coef)


@pytest.mark.parametrize(
    "method, scales",
    [("centering", [1, 1, 1]), ("autoscaling", [1.2909944487, 2.2173557826, 2.7537852736]), ("rangescaling", [3, 5, 6]), ("paretoscaling", [1.1362193665, 1.4890788369, 1.6594533057])],
)
def test_scaling(spark, method, scales):
    out = P.scale(frame(spark, TRAIN), method, frame(spark, TEST))
    x, mean = np.array(TRAIN, float), np.mean(TRAIN, axis=0)
    assert np.allclose([r.vec for r in parts(out, "train")], (x - mean) / scales, atol=1e-6)
    assert np.allclose([r.vec for r in parts(out, "test")], (np.array(TEST) - mean) / scales, atol=1e-6)


def test_constant_column_divides_as_floating_point(spark):
    got = parts(P.scale(frame(spark, [[1, 1], [1, 2]]), "autoscaling", frame(spark, [[3, 0]])), "test")[0].vec
    assert got[0] == math.inf


def test_unit_vectors(spark):
    got = [r.vec for r in P.l2_normalize(frame(spark, [[3, 4], [0, 0]])).orderBy("id").collect()]
    assert np.allclose(got, [[0.6, 0.8], [0, 0]])


def test_validation(spark):
    assert P.validate(frame(spark, TRAIN)) == (4, 3)
    for bad in ([], [[1, 2], [1]], [[math.nan]], [[math.inf]]):
        with pytest.raises(ValueError):
            P.validate(frame(spark, bad))
    with pytest.raises(ValueError):
        P.validate(spark.createDataFrame([(1, None)], "id long, vec array<double>"))
    with pytest.raises(ValueError):
        P.normalize(frame(spark, TRAIN), "other")


def test_renumber_and_encode(spark):
    g = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "id long, k string")
    assert {r.id: r.grp for r in P.renumber(g, "k").collect()} == {1: 1, 2: 2, 3: 1, 4: 3}
    assert {r.id: r.code for r in P.encode_labels(g, "k").collect()} == {1: 2, 2: 1, 3: 2, 4: None}


def test_gram_and_median(spark):
    x = np.array(TRAIN, float)
    g = {(r.a, r.b): r.v for r in P.gram(frame(spark, TRAIN)).collect()}
    assert np.allclose([g[a, b] for a in range(3) for b in range(a, 3)], [(x.T @ x)[a, b] for a in range(3) for b in range(a, 3)])
    from pyspark.sql import functions as F

    m = spark.createDataFrame([([1.0, math.nan, 3.0],), ([4.0, 1.0, 2.0, 3.0],), ([math.nan],)], "vec array<double>").select(P.median(F.col("vec")).alias("m")).collect()
    assert m[0].m == 2 and m[1].m == 2.5 and math.isnan(m[2].m)
