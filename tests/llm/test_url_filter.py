"""op6 against brute force."""

import datetime as dt
import random
import re

from tessera.llm.url_filter import filter_urls

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute(captures, entries):
    on = {}
    for lst, kind, pattern, action, n in entries:
        if None not in (lst, kind, pattern, action, n) and kind in ("host", "domain", "prefix") and action in ("add", "remove"):
            on.setdefault((lst, kind, pattern.lower()), []).append((n, action))
    out = []
    for i, url, n in captures:
        rules = []
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)", url or "")
        host = m[1].lower().rstrip(".") if m else ""
        if host and n is not None:
            path = m[2] or "/"
            for (lst, kind, pattern), log in on.items():
                clean = pattern.rstrip("/") if kind == "prefix" else pattern.rstrip(".")
                full = (host + path).lower()
                hit = {"host": host == clean, "domain": host == clean or host.endswith("." + clean), "prefix": full == clean or full.startswith(clean + "/")}[kind]
                past = sorted(x for x in log if x[0] <= n)
                if hit and past and max(past, key=lambda x: (x[0], x[1]))[1] == "add":
                    rules.append(f"{lst}:{kind}:{pattern}")
        out.append((i, bool(rules), sorted(rules)))
    return sorted(out, key=str)


def run(spark, captures, entries):
    c = spark.createDataFrame([(i, u, at(n), 1, "z") for i, u, n in captures], "page_id long, url string, fetched_at timestamp, host int, key string")
    e = spark.createDataFrame([(*x[:4], at(x[4])) for x in entries], "list string, kind string, pattern string, action string, dated timestamp")
    return sorted(((r.kept_page_id, r.blocked, r.rules) for r in filter_urls(c.repartition(3), e, keep=("page_id",)).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(0)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "notexample.com"]
    entries = []
    for _ in range(160):
        kind = rng.choice(["host", "domain", "prefix"])
        h = rng.choice(hosts)
        entries.append((rng.choice(["s", "t"]), kind, h + (rng.choice(["/p", "/p/q", "/p/"]) if kind == "prefix" else ""), rng.choice(["add", "add", "remove"]), rng.randrange(400)))
    entries += [("s", "host", None, "add", 1), ("s", "host", "x.org", "drop", 1), ("s", "word", "x.org", "add", 1), ("s", "host", "x.org", "add", None), ("s", "domain", "X.ORG", "add", 7)]
    captures = []
    for i in range(300):
        u = rng.choice(["http", "https"]) + "://" + rng.choice(["", "u@"]) + rng.choice(hosts).upper() + rng.choice(["", ":80"]) + rng.choice(["", "/", "/p", "/p/q/r", "/pq", "/P/Q?x=/p#y", "?q=1"])
        captures.append((i, u, rng.randrange(500)))
    captures += [(900, None, 3), (901, "", 3), (902, "/p/q", 3), (903, "http://x.org", None), (None, "http://x.org/", 300), (904, "http://x.org./p", 300), (905, "http://x.org/" + "p/" * 20_000, 300)]
    captures += [(906, "http://a.example.com/p", 200)] * 400  # one hot host, repeated rows
    assert run(spark, captures, entries) == brute(captures, entries)


def test_empty(spark):
    assert run(spark, [], [("s", "host", "x.org", "add", 1)]) == []
    assert run(spark, [(1, "http://x.org", 5)], []) == [(1, False, [])]
