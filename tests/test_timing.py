import pytest

from tessera.operators.timing import Timings


def test_steps_add_up(spark):
    t = Timings()
    assert t.table(spark).collect() == []
    for name in ("graph", "runs", "graph"):
        with t.step(name):
            pass
    with pytest.raises(KeyError), t.step("fails"):
        raise KeyError
    rows = t.table(spark).collect()
    assert [r.step for r in rows] == ["graph", "runs", "fails"] and abs(sum(r.percent for r in rows) - 100) < 1e-9 and all(r.seconds >= 0 for r in rows)
