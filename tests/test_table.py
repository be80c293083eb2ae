import numpy as np

from tessera.functions import table
from tessera.operators.sampling import shuffled


def test_medians_with_and_without_a_bracket(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(c, float(v)) for c, n in ((0, 1), (1, 2), (2, 501), (3, 500)) for v in rng.normal(size=n).round(1 + c % 2)]
    long = spark.createDataFrame(rows, "c int, v double").repartition(5)
    want = {c: float(np.median([v for k, v in rows if k == c])) for c in range(4)}
    assert {r.c: round(r.v, 9) for r in table.medians(long).collect()} == {c: round(v, 9) for c, v in want.items()}
    monkeypatch.setattr(table, "SKETCH", 100)
    assert {r.c: round(r.v, 9) for r in table.medians(long).collect()} == {c: round(v, 9) for c, v in want.items()}


def test_ranks_within_a_crowded_group(spark):
    rows = spark.createDataFrame([(i, 0 if i < 900 else 1) for i in range(1000)], "id long, g int")
    got = table.ranked(rows, ["g"], shuffled(3, "id"), "id").collect()
    import hashlib

    for g in (0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        keys = [hashlib.md5(f"3:{r.id}".encode()).hexdigest() for r in own]
        assert [r.r for r in own] == list(range(1, len(own) + 1)) and keys == sorted(keys)


def test_numbers(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "id long").repartition(6)
    assert {r.id: r.number for r in table.numbered(rows, "id").collect()} == {i: i + 1 for i in range(101)}
    assert table.numbered(rows.limit(0), "id").collect() == []


def test_beside(spark):
    one = spark.createDataFrame([(7,)], "x int")
    assert sorted(tuple(r) for r in spark.range(2).transform(table.beside, one).collect()) == [(0, 7), (1, 7)]
