"""Graph weights, components, clustering and Laplacian features over edge lists (i, rank, j, dist)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.functions.table import beside
from tessera.session import bounded, prepare, written

WEIGHTS = ("distance", "adaptive", "binary", "snn")
#: Undirected edges that a sequential graph algorithm takes into one task; more raise TooLarge.
MOST_EDGES = 20_000_000
#: Bytes of the walks of all rows (rows x rows numbers), at most, and rows up to which they are powers of a dense matrix.
MOST_WALKS, MOST_DENSE = 4 << 30, 4_000


def undirected(edges: DataFrame) -> DataFrame:
    """edges(i, j, w) -> (a, b, w), a < b, the largest weight of either direction."""
    return edges.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("w").alias("w"))


def weigh(edges: DataFrame, kind: str = "distance", prune: float = 0.0, mutual: bool = False) -> DataFrame:
    """(a, b, w): distance 1 / (1 + d); adaptive exp(-d^2 / (s_i s_j)), s the last positive finite distance of a
    row; binary 1; snn the Jaccard overlap of the rows' neighbour lists, for pairs that share one. Only w > prune stays;
    self-loops don't count, and distance and adaptive leave out edges without a finite distance of 0 or more.
    mutual: only edges whose reverse is in the graph; for snn, only such neighbours of the row with the smaller id are looked up in the
    other's list, and lists keep their sizes.
    """
    if kind not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    edges = edges.where("i <> j")
    every = edges
    if mutual:
        edges = edges.join(edges.select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"], "left_semi")
    finite = edges.where("dist is not null and not isnan(dist) and dist >= 0 and dist < double('infinity')")
    if kind == "distance":
        out = undirected(finite.select("i", "j", (1 / (1 + F.col("dist"))).alias("w")))
    elif kind == "binary":
        out = undirected(edges.select("i", "j", F.lit(1.0).alias("w")))
    elif kind == "adaptive":
        last = every.where("dist > 0 and dist < double('infinity') and not isnan(dist)").groupBy("i").agg(F.max_by("dist", "rank").alias("s"))
        s = lambda c: last.select(F.col("i").alias(c), F.col("s").alias(f"s_{c}"))
        both = finite.join(s("i"), "i", "left").join(s("j"), "j", "left").fillna(1.0, ["s_i", "s_j"])
        out = undirected(both.select("i", "j", F.exp(-F.col("dist") * F.col("dist") / (F.col("s_i") * F.col("s_j"))).alias("w")))
    else:
        out = shared_neighbours(every, edges if mutual else None)
    return out.where(F.col("w") > prune)


def shared_neighbours(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(a, b, w) for pairs of rows whose neighbour lists share a row: shared / (deg a + deg b - shared). asked: the edges that a's list is cut to for the shared rows.

    Pairs of one neighbour's rows are the result itself, so they can't be avoided; a row that very many
    rows name (a hub) is dealt by salted groups: its list is split and the parts meet in pairs of parts.
    """
    e = edges.select("i", "j").distinct()
    degree = e.groupBy("i").agg(F.count("*").alias("d"))
    parts = e.groupBy("j").agg(F.ceil(F.count("*") / 256).alias("parts"))
    deal = lambda x: x.join(parts, "j").withColumn("p", F.pmod(F.xxhash64("i"), F.col("parts")))
    dealt, ask = deal(e), deal(e if asked is None else asked.select("i", "j").distinct())
    one = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    left = ask.withColumn("q", F.explode(one)).select("j", "p", "q", F.col("i").alias("a"))
    right = dealt.withColumnRenamed("p", "q").withColumn("p", F.explode(one)).select("j", "p", "q", F.col("i").alias("b"))
    shared = left.join(right, ["j", "p", "q"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("s"))
    d = lambda c: degree.select(F.col("i").alias(c), F.col("d").alias(f"d_{c}"))
    return shared.join(d("a"), "a").join(d("b"), "b").select("a", "b", (F.col("s") / (F.col("d_a") + F.col("d_b") - F.col("s"))).alias("w"))


def binary_union(edges: DataFrame) -> DataFrame:
    """(i, j, w = 1): every edge and its reverse once, no self-loops. ValueError if nothing is left."""
    e = edges.where("i <> j").select("i", "j")
    out = e.union(e.select("j", "i")).distinct().withColumn("w", F.lit(1.0))
    if out.isEmpty():
        raise ValueError("no edges between different rows")
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(id), edges(a, b) -> (id, component): the smallest id that edges reach.

    Edges are contracted: in each round nodes move to the best-ranked of themselves and their neighbours,
    ranks drawn anew, until no edge joins different nodes.
    """
    roots = written(nodes.select("id").distinct().withColumn("root", F.col("id")), "roots")
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    step = 0
    while not edges.isEmpty():
        step += 1
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("r"), c.alias("to"))  # noqa: E731, B023
        both = edges.union(edges.select("b", "a"))
        moves = both.groupBy(F.col("a").alias("from")).agg(F.min(ranked(F.col("b"))).alias("m"))
        moves = written(moves.select("from", F.least("m", ranked(F.col("from")))["to"].alias("to")), "moves")
        roots = written(roots.join(moves, roots["root"] == moves["from"], "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        for c in ("a", "b"):
            edges = edges.join(moves.select(F.col("from").alias(c), F.col("to").alias(f"{c}2")), c)
        edges = written(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "edges")
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(least, "root").select("id", "component")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges(a, b, w), labels(id, label) -> (modularity): internal share of weight minus the squares of the classes' shares of degree."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    e = edges.join(of("a"), "a").join(of("b"), "b")
    inside = e.agg(F.sum(F.when(F.col("l_a") == F.col("l_b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    degree = e.select(F.col("l_a").alias("l"), "w").union(e.select("l_b", "w")).groupBy("l").agg(F.sum("w").alias("d"))
    squares = degree.transform(beside, (inside.select("m"))).agg(F.sum((F.col("d") / (2 * F.col("m"))) ** 2).alias("squares"))
    return inside.transform(beside, squares).select((F.col("inside") / F.col("m") - F.col("squares")).alias("modularity"))


def _one_task(edges: DataFrame, nodes: DataFrame, kernel, schema: str, what: str, most: int = MOST_EDGES) -> DataFrame:
    """A sequential kernel over a whole graph, whose size is checked first: kernel(ids, a, b, w) -> pandas."""
    prepare(edges.sparkSession)
    bounded(edges, most, what)
    n = nodes.select(F.lit(0).alias("g"), F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("w"))
    e = edges.select(F.lit(0).alias("g"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["b"].isna(), "a"].unique())
        e = pdf[pdf["b"].notna()].sort_values(["a", "b"])
        return kernel(ids, np.searchsorted(ids, e["a"].to_numpy()), np.searchsorted(ids, e["b"].to_numpy(np.int64)), e["w"].to_numpy())

    return n.union(e).groupBy("g").applyInPandas(run, schema)


def _roots(n: int):
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    return root, find


def spanning_components(edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    """(id, component from 1): edges (a, b, w) joined by increasing (w, a, b) until at most target components are left."""

    def kernel(ids, a, b, w):
        root, find = _roots(len(ids))
        left = len(ids)
        for e in np.lexsort((b, a, w)):
            if left <= target:
                break
            x, y = find(a[e]), find(b[e])
            if x != y:
                root[max(x, y)] = min(x, y)
                left -= 1
        own = np.array([find(i) for i in range(len(ids))])
        return pd.DataFrame({"id": ids, "component": np.unique(own, return_inverse=True)[1] + 1})

    return _one_task(edges, nodes, kernel, "id long, component int", "edges of a spanning forest")


def balanced_regions(edges: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """(id, region from 1): the spanning forest of the lightest edges cut, children before parents, into regions of at least ceil(1 / resolution) rows."""
    least = max(1, int(np.ceil(1 / resolution)))

    def kernel(ids, a, b, w):
        n = len(ids)
        root, find = _roots(n)
        tree: list[list[int]] = [[] for _ in range(n)]
        for e in np.lexsort((b, a, w)):
            x, y = find(a[e]), find(b[e])
            if x != y:
                root[max(x, y)] = min(x, y)
                tree[a[e]].append(int(b[e]))
                tree[b[e]].append(int(a[e]))
        region, parent = np.full(n, -1), np.full(n, -1)
        for start in range(n):
            if parent[start] >= 0 or region[start] >= 0:
                continue
            order, stack = [], [start]
            parent[start] = start
            while stack:
                x = stack.pop()
                order.append(x)
                for y in tree[x]:
                    if parent[y] < 0:
                        parent[y] = x
                        stack.append(y)
            size = dict.fromkeys(order, 1)
            cut, last = {start}, -1
            for x in reversed(order):
                if x == start:
                    continue
                if size[x] >= least:
                    cut.add(x)
                    last = x
                else:
                    size[parent[x]] += size[x]
            if size[start] < least and last >= 0:  # too few left at the root: they join a neighbouring region
                near = next(x for x in reversed(order) if x in cut and x != start and _reaches(x, parent, cut, start))
                cut.discard(near)
            for x in order:
                region[x] = x if x in cut else region[parent[x]]
        return pd.DataFrame({"id": ids, "region": np.unique(region, return_inverse=True)[1] + 1})

    return _one_task(edges, nodes, kernel, "id long, region int", "edges of a spanning forest")


def _reaches(x, parent, cut, start) -> bool:
    p = parent[x]
    while p not in cut:
        p = parent[p]
    return p == start


def walktrap(edges: DataFrame, nodes: DataFrame, steps: int = 4, target: int = 0, most_nodes: int = int((MOST_WALKS / 8) ** 0.5)) -> DataFrame:
    """(id, cluster from 1): random-walk clustering of the undirected weighted graph (a, b, w).

    A row's walk has a loop of its mean edge weight. Adjoining clusters merge by the least increase of the
    walks' spread (ties: smaller numbers first); the cut is of the largest modularity, or of target clusters,
    for which what the walks can't join merges by the largest weight between, relative to sqrt(vol vol).
    ValueError if target is below the number of components or above the rows. Rows are counted first: the
    merge order is sequential and compares walks that reach most rows, so at most most_nodes (23,170: their walks are 4 GB) meet in one task.
    """
    n = bounded(nodes.select("id").distinct(), most_nodes, "rows to cluster by walks")
    if target > n:
        raise ValueError("more clusters than rows")
    if target:
        parts = components(edges, nodes).select("component").distinct().count()
        if target < parts:
            raise ValueError("fewer clusters than components")

    def kernel(ids, a, b, w):
        return pd.DataFrame({"id": ids, "cluster": walk_clusters(len(ids), a, b, w, steps, target)})

    return _one_task(edges, nodes, kernel, "id long, cluster int", "edges to cluster by walks")


def _sparse_walks(n: int, a, b, w, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(degree, walks of all rows over the roots of the volumes): edges are walked for a stretch of columns after another, so only the walks themselves are rows x rows."""
    i, j, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    degree, count = np.bincount(i, v, n), np.bincount(i[v > 0], minlength=n)
    loops = np.where(count > 0, degree / np.maximum(count, 1), 1.0)
    volume = degree + loops
    i, j, v = np.concatenate([i, np.arange(n)]), np.concatenate([j, np.arange(n)]), np.concatenate([v, loops])
    v = v / volume[i]
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    width = np.bincount(i, minlength=n)
    first = np.cumsum(width) - width
    by = np.argsort(-width, kind="stable")  # rows of many edges first, so that the k-th edges are those of the first rows
    slots = [by[: np.searchsorted(-width[by], -k, "left")] for k in range(width.max())]
    p = np.empty((n, n))
    for u in range(0, n, 64):
        here = (j >= u) & (j < u + 64)
        x = np.zeros((n, min(64, n - u)))
        x[i[here], j[here] - u] = v[here]
        for _ in range(steps - 1):
            y = np.zeros_like(x)
            for k, rows in enumerate(slots):
                at = first[rows] + k
                y[rows] += v[at, None] * x[j[at]]
            x = y
        p[:, u : u + 64] = x
    p /= np.sqrt(volume)[None, :]
    return degree, p


def walk_clusters(n: int, a, b, w, steps: int, target: int) -> np.ndarray:
    if n <= MOST_DENSE:
        adj = np.zeros((n, n))
        adj[a, b] = w
        adj[b, a] = w
        count = (adj > 0).sum(axis=1)
        loops = np.where(count > 0, adj.sum(axis=1) / np.maximum(count, 1), 1.0)
        full = adj + np.diag(loops)
        volume = full.sum(axis=1)
        walk = full / volume[:, None]
        p = np.linalg.matrix_power(walk, steps) / np.sqrt(volume)[None, :]
        degree = adj.sum(axis=1)
    else:
        degree, p = _sparse_walks(n, a, b, w, steps)
    size, alive = np.ones(n), np.ones(n, bool)
    member = np.arange(n)
    between = {}
    for x, y, v in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        between.setdefault(x, {})[y] = between.setdefault(x, {}).get(y, 0.0) + v
        between.setdefault(y, {})[x] = between[x][y]
    gap = np.empty(n)

    def spread(x: int, y: int) -> float:
        np.subtract(p[x], p[y], out=gap)
        return size[x] * size[y] / (size[x] + size[y]) * float(np.square(gap).sum() if n <= MOST_DENSE else gap @ gap) / n

    heap = [(spread(x, y), min(x, y), max(x, y), 1, 1) for x in between for y in between[x] if x < y]
    heapq.heapify(heap)
    version = np.ones(n, int)
    total = w.sum()
    q = -float(np.square(degree / (2 * total)).sum()) if total else 0.0
    best_q, best, clusters = q, member.copy(), n
    if target and clusters == target:
        return np.unique(member, return_inverse=True)[1] + 1
    while heap:
        _, x, y, vx, vy = heapq.heappop(heap)
        if not (alive[x] and alive[y]) or version[x] != vx or version[y] != vy:
            continue
        q += between[x][y] / total - 2 * degree[x] * degree[y] / (2 * total) ** 2
        p[x] = (size[x] * p[x] + size[y] * p[y]) / (size[x] + size[y])
        size[x] += size[y]
        degree[x] += degree[y]
        alive[y] = False
        member[member == y] = x
        version[x] += 1
        for z, v in between.pop(y).items():
            between[z].pop(y)
            if z != x:
                between[x][z] = between[x].get(z, 0.0) + v
                between[z][x] = between[x][z]
        for z in between[x]:
            i, j = min(x, z), max(x, z)
            heapq.heappush(heap, (spread(x, z), i, j, version[i], version[j]))
        clusters -= 1
        if target:
            if clusters == target:
                break
        elif q > best_q + 1e-12:
            best_q, best = q, member.copy()
    return np.unique(member if target else best, return_inverse=True)[1] + 1


def merge_to(edges: DataFrame, labels: DataFrame, target: int) -> DataFrame:
    """labels(id, label) merged to target classes: always the two with the largest weight between over sqrt(vol vol). Classes meet on the driver: they are counted first, more than 5,000 raise TooLarge."""
    bounded(labels.select("label").distinct(), 5_000, "classes to merge")
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    e = edges.join(of("a"), "a").join(of("b"), "b").groupBy(F.least("l_a", "l_b").alias("x"), F.greatest("l_a", "l_b").alias("y")).agg(F.sum("w").alias("w"))
    classes = sorted(r.label for r in labels.select("label").distinct().collect())
    to = {c: c for c in classes}
    weight = {(r.x, r.y): r.w for r in e.collect()}
    while len(set(to.values())) > target:
        vol: dict = {}
        between: dict = {}
        for (x, y), v in weight.items():
            x, y = sorted((to[x], to[y]))
            vol[x] = vol.get(x, 0.0) + v
            vol[y] = vol.get(y, 0.0) + v
            if x != y:
                between[x, y] = between.get((x, y), 0.0) + v
        if not between:
            raise ValueError("fewer clusters than components")
        x, y = max(between, key=lambda p: (between[p] / np.sqrt(vol[p[0]] * vol[p[1]]), -p[0], -p[1]))
        to = {c: x if t == y else t for c, t in to.items()}
    table = labels.sparkSession.createDataFrame([(int(a), int(b)) for a, b in to.items()], "label int, merged int")
    return labels.join(F.broadcast(table), "label").select("id", F.col("merged").alias("label"))


def cluster_graph(edges: DataFrame, nodes: DataFrame, weight: str = "distance", steps: int = 4, target: int = 0, prune: float = 0.0, mutual: bool = False) -> DataFrame:
    """Weights, then walks: (id, cluster)."""
    return walktrap(written(weigh(edges, weight, prune, mutual), "weights"), nodes, steps, target)


#: Components that are bridged: their shortest tree takes as many steps of as many distances.
MOST_PARTS = 50_000


def _shortest_tree(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the shortest tree over points, from the first on; ties go to the end joined first, then to the smaller one. One row of distances is held at a time."""
    left, near, far, at = np.arange(1, len(x)), x[1:].copy(), np.full(len(x) - 1, np.inf), np.zeros(len(x) - 1, int)
    joined, out = [0], []
    while len(left):
        d = np.sqrt(((x[joined[-1]] - near) ** 2).sum(axis=1))
        closer = d < far
        far[closer], at[closer] = d[closer], len(joined) - 1
        ties = np.flatnonzero(far == far.min())
        k = ties[np.lexsort((left[ties], at[ties]))[0]]
        out.append((joined[at[k]], int(left[k])))
        joined.append(int(left[k]))
        last = len(left) - 1  # the last takes its place
        left[k], near[k], far[k], at[k] = left[last], near[last], far[last], at[last]
        left, near, far, at = left[:last], near[:last], far[:last], at[:last]
    return out


def bridged(edges: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """edges(a, b, w) with its components joined by a shortest tree over their centroids, each bridge of the median weight between the rows of smallest id. Components are few and meet on the driver."""
    parts = written(components(edges, nodes), "parts")
    long = rows.select("id", F.posexplode(V.doubles(F.col("vec"))).alias("c", "v")).join(parts, "id").groupBy("component", "c").agg(F.avg("v").alias("v"))
    found = written(long.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"]).alias("m")), "centroids")
    bounded(found, MOST_PARTS, "components to bridge")
    found = sorted(found.collect())
    if len(found) < 2:
        return edges.select("a", "b", "w")
    bridges = [(min(e), max(e)) for e in ((found[i].component, found[j].component) for i, j in _shortest_tree(np.array([r.m for r in found])))]
    w = edges.agg(F.median("w")).first()[0] or 1.0
    return edges.select("a", "b", "w").union(edges.sparkSession.createDataFrame([(*b, float(w)) for b in bridges], "a long, b long, w double"))


def laplacian_weights(edges: DataFrame) -> DataFrame:
    """(a, b, w): exp(-d^2 / (s_i s_j)) with s a row's upper-median neighbour distance (its mean where that is 0, at least 1e-6, 1 for rows without
    one), the larger of both directions, over the root of both rows' degrees. Negative distances count as 0, edges without a finite one not at all."""
    edges = edges.where("i <> j and dist is not null and not isnan(dist) and abs(dist) < double('infinity')").select("i", "j", F.greatest("dist", F.lit(0.0)).alias("dist"))
    mid = edges.groupBy("i").agg(F.sort_array(F.collect_list("dist")).alias("d"), F.avg("dist").alias("mean"))  # k distances a row
    mid = mid.select("i", F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("s"), "mean")
    scale = F.greatest(F.when(F.col("s") > 1e-6, F.col("s")).otherwise(F.col("mean")), F.lit(1e-6))
    s = lambda c: mid.select(F.col("i").alias(c), scale.alias(f"s_{c}"))
    both = edges.join(s("i"), "i", "left").join(s("j"), "j", "left").fillna(1.0, ["s_i", "s_j"])
    w = undirected(both.select("i", "j", F.exp(-F.col("dist") * F.col("dist") / (F.col("s_i") * F.col("s_j"))).alias("w")))
    degree = w.select("a", "w").union(w.select("b", "w")).groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d"))
    d = lambda c: degree.select(F.col("id").alias(c), F.col("d").alias(f"d_{c}"))
    return w.join(d("a"), "a").join(d("b"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d_a") * F.col("d_b"))).alias("w"))


def laplacian_features(edges: DataFrame, nodes: DataFrame, dims: int = 8, steps: int = 8, seed: int = 1234) -> DataFrame:
    """(id, vec): power iterations of the normalised graph from hashed normal numbers, orthonormalised, standardised.

    Each step is one sparse product (a join and a sum); only dims x dims products come to the driver.
    """
    w = written(laplacian_weights(edges), "laplacian")
    both = written(w.select("a", "b", "w").union(w.select("b", "a", "w")), "both")
    from .spatial import hashed_uniform

    gauss = F.array(*(F.sqrt(-2 * F.log(1 - hashed_uniform(seed, F.col("id"), F.lit(f"r{c}")))) * F.cos(2 * np.pi * hashed_uniform(seed, F.col("id"), F.lit(f"a{c}"))) for c in range(dims)))
    x = written(nodes.select("id").distinct().select("id", gauss.alias("vec")), "start")
    for _ in range(steps):
        x = written(_orthonormal(x, dims), "step")
        step = both.join(x.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.transform("vec", lambda v: v * F.col("w")).alias("vec"))
        cols = step.groupBy("id").agg(*(F.sum(F.get("vec", c)).alias(f"c{c}") for c in range(dims)))
        x = written(x.select("id").join(cols, "id", "left").select("id", F.array(*(F.coalesce(f"c{c}", F.lit(0.0)) for c in range(dims))).alias("vec")), "step")
    x = written(_orthonormal(x, dims), "last")
    from .preprocess import scale

    return scale(x, "autoscaling").select("id", "vec")


def _orthonormal(x: DataFrame, dims: int) -> DataFrame:
    from .preprocess import gram

    g = np.zeros((dims, dims))
    for r in gram(x).collect():  # dims x dims
        g[r.a, r.b] = g[r.b, r.a] = r.v
    values, vectors = np.linalg.eigh(g)
    t = vectors / np.sqrt(np.maximum(values, 1e-300))[None, :]
    t = t[:, ::-1]
    return x.select("id", F.array(*(V.total(F.zip_with("vec", F.array(*map(F.lit, map(float, t[:, c]))), lambda a, b: a * b)) for c in range(dims))).alias("vec"))
