"""op9 against brute force."""

import math
import random

from tessera.llm import topk
from tessera.llm.topk import exact_topk


def brute(rows, k, step):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % step == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), c) for m, (c, b) in enumerate(ok) if m != n)
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k=20, step=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int, id string" if rows and len(rows[0]) > 2 else "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in exact_topk(df.repartition(3), f"id % {step} = 0", k).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(900)]
    rows += [(2000 + i, [0.5] * 40) for i in range(60)]  # ties
    rows += [(3000, None), (3020, [None] * 40), (3040, [math.nan] * 40), (3060, [math.inf] + [0.0] * 39), (None, [1.0] * 40), (3080, []), (3100, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 20, 20)


def test_long_vectors_meet_in_small_groups(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 150, [rng.gauss(0, 1) for _ in range(rng.choice([0, 5, 64]))]) for i in range(200)]
    monkeypatch.setattr(topk, "TASK_BYTES", 64 * 8 * 9)
    assert run(spark, rows, k=5, step=10) == brute(rows, 5, 10)


def test_few_rows_and_huge_values(spark):
    assert run(spark, []) == []
    rows = [(0, [1.0]), (1, [1.0]), (1, [2.0]), (1, [1.0]), (0, [1.0])]
    assert run(spark, rows) == brute(rows, 20, 20) and len(run(spark, rows)) == 8
    rows = [(0, [1e6, 1.0]), (1, [1e6, -1.0]), (2, [-1e6, 3.0])]
    assert run(spark, rows) == brute(rows, 20, 20)
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e7, -1e7, 3e6, 1.0]) * rng.random() for _ in range(5)]) for i in range(120)]
    assert run(spark, rows, k=3) == brute(rows, 3, 20)
    assert run(spark, [(0, [1e30]), (1, [1e30])])[0][3] == 2**63 - 1
    assert run(spark, [(0, [1.0], 1, 2, "a"), (5, [2.0], 1, 2, "b")]) == [(0, 1, 5, 8192)]
