"""op2 against brute force."""

import random

from tessera.llm.ngram_join import HOT, LONG_LIST, divide_skip, near_duplicates


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in w).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and s[j] and 100 * n >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near(rng, words, share):
    return " ".join(rng.choice("abcdefghij") * 6 if rng.random() < share else w for w in words)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in near_duplicates(df).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [rng.choices(vocab, k=60) for _ in range(12)]
    passage = " ".join(rng.choices(vocab, k=25))
    for i in range(220):
        rows.append((i * 3, near(rng, rng.choice(base), rng.choice([0, 0.01, 0.03, 0.05, 0.08]))))
    hub = rng.choices(vocab, k=80)  # a group of copies with inverted lists that are too long to merge
    rows += [(1000 + i, near(rng, hub, rng.choice([0.01, 0.03, 0.06]))) for i in range(3 * LONG_LIST)]
    rows += [(2000 + i, passage + " " + " ".join(rng.choices(vocab, k=rng.choice([3, 8, 40])))) for i in range(90)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "A b c"), (3004, "a B\nc"), (3005, "a b"), (3006, "a b c d e f"), (3007, "é　x y z q r"), (3008, "x" * 200_000)]
    rows += [(4000 + i, "the very same text of nine words is here") for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_lists_that_are_never_gathered(spark):
    """More copies and near copies of a text than HOT: their lists are dealt by set."""
    rng = random.Random(3)
    hub = rng.choices([f"w{i}" for i in range(200)], k=30)
    rows = [(i, " ".join(hub)) for i in range(HOT + 300)]
    rows += [(10_000 + i, near(rng, hub, rng.choice([0.03, 0.08, 0.3]))) for i in range(150)]
    got = {d: c for d, _, c in run(spark, rows)}
    few = [(0, " ".join(hub)), *rows[HOT + 300 :]]
    want = {d: c for d, _, c in brute(few)}
    assert all(got[i] == 0 for i in range(HOT + 300)) and all(got[d] == c for d, c in want.items())


def test_small_groups_and_blocks(spark, monkeypatch):
    """Lists whose sets are partly unlike their hub and of many sizes, in many blocks and groups."""
    from tessera.llm import ngram_join as N

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=120)
    rows = [(i, " ".join(passage[: rng.randrange(40, 120)] + rng.choices(vocab, k=rng.randrange(0, 12)))) for i in range(160)]
    rows += [(500 + i, near(rng, passage * 3, rng.choice([0, 0.02, 0.05]))) for i in range(90)]
    want = brute(rows)
    for name, value in (("BLOCK", 8), ("QUERIES", 16), ("SALTS", 3)):
        monkeypatch.setattr(N, name, value)
    assert run(spark, rows) == want


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w")]
    assert {(r[0], r[2]) for r in run(spark, rows)} == {(1, 1), (2, 1)}
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, node string, fp string")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 1, 1)]


def test_divide_skip():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    index = [np.unique(np.concatenate([base[rng.random(100) < 0.9], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(60)]
    for q, got in zip(index, divide_skip(index, index), strict=True):
        want = [i for i, s in enumerate(index) if 7 * len(np.intersect1d(q, s)) >= 3 * (len(q) + len(s))]
        assert sorted(got) == want
