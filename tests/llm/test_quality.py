"""op10: held-out accuracy, scores against plain algebra, odd rows."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import quality as Q
from tessera.llm.language_id import held_out


def corpus(n=600):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices(["er", "th", "on", "in", "a", "re"], k=rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        bad = i % 6 == 0
        if bad:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "%%%" for w in words], words[:4] * 20])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy_and_scores(spark):
    rows, labels = corpus()
    m = Q.measure(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.fit(m.where(~held_out()), lab)
    got = {r.doc_id: r for r in Q.score(m, model).withColumn("h", held_out()).collect()}
    test = [(i, y) for i, y in labels if got[i].h]
    assert len(test) > 30 and np.mean([(got[i].score >= 0.3) == (y == 1) for i, y in test]) > 0.95
    x = np.array([got[i].x for i, _ in labels if not got[i].h])
    y = np.array([y for i, y in labels if not got[i].h])
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    ridge = np.diag(Q.IDENTITY * np.diag(pooled) + 1e-6)
    for i in (0, 1, 6, 7):
        log = []
        for k in (0, 1):
            c = (1 - Q.POOLED) * cov[k] + Q.POOLED * pooled + ridge
            d = np.array(got[i].x) - x[y == k].mean(axis=0)
            log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d))
        assert abs(got[i].score - 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))) < 1e-6


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "x", 3.0), (None, "a b", 4.0), (3, "x", 3.0), (4, "x " * 300_000, 0.0), (5, "x" * 1_000_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    m = Q.measure(df)
    for labels, want in (([], 0.5), ([(3, 1)], 1.0), ([(3, 0), (1, None), (2, 7)], 0.0)):
        model = Q.fit(m, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = Q.score(m, model).collect()
        assert len(got) == len(rows) and {r.score for r in got} == {want}
    both = Q.fit(m, spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in Q.score(m, both).collect())
    assert Q.score(Q.measure(df.limit(0)), both).collect() == []


def test_statistics():
    s = dict(zip(Q.NAMES, Q.statistics(pa.array(["a a B!! c\nd d"]))[0]))
    assert abs(s["log_words"] - np.log1p(6)) < 1e-9 and abs(s["again"] - np.sqrt(2 / 6)) < 1e-9 and abs(s["distinct_words"] - 4 / 6) < 1e-9
    assert abs(s["marked_words"] - np.sqrt(1 / 6)) < 1e-9 and abs(s["lines"] - np.log1p(1)) < 1e-9
    assert not Q.statistics(pa.array([None, ""], pa.string())).any()
