"""op3 against brute force."""

import random

from tessera.llm import decontaminate
from tessera.llm.decontaminate import contamination


def words(t):
    out, cur = [], ""
    for c in (t or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c >= "\x80" or "a" <= c <= "z" or "0" <= c <= "9":
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return out


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for g, ids in wins.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    own |= ids
        out.append((d, len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(d, b).collect()
    for r in found:
        assert r.n_hit == sum(s.end - s.first for s in r.hit_spans)
        assert all(x.end < y.first for x, y in zip(r.hit_spans, r.hit_spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found), key=str)


def case():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["é", "naïve"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([2, 4, 11, 13, 14, 30])))) for i in range(25)]
    items += [(100, None), (None, "a b c"), (101, ""), (102, "..."), (103, items[3][1]), (3, "zz yy xx"), (104, "Solo")]
    docs = []
    for i in range(150):
        w = rng.choices(vocab, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            w[(p := rng.randrange(len(w) + 1)) : p] = rng.choice([t, t.upper(), t.replace(" ", ", ")]).split(" ")
        docs.append((i, rng.choice([" ", "-", " \n"]).join(w)))
    docs += [(900, None), (901, ""), (902, items[5][1]), (902, items[5][1]), (903, "zz yy"), (904, "xx zz yy xx solo"), (905, "q " * 200_000 + (items[4][1] or ""))]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    assert run(spark, docs, items) == brute(docs, items)


def test_a_large_benchmark_is_joined_by_token(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs[:3], [(1, "...")]) == brute(docs[:3], [(1, "...")])


def test_empty(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    d = spark.createDataFrame([(1, "a b", 1, "x")], "doc_id long, text string, item_id int, uid string")
    assert contamination(d, spark.createDataFrame([(7, "A b")], "item_id long, text string")).first()["items"] == ["7"]
