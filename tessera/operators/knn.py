"""Nearest-neighbour joins and neighbour graphs.

A graph is an edge list (i, rank, j, dist): rank from 1, by (dist, j). The exact join meets blocks of
queries with blocks of base rows (an equality join on block numbers, so every pair of blocks is one task
of bounded size) and merges each query's k best; ivf_join looks only into the cells nearest to a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vec
from tessera.session import partitions, prepare, written

METRICS = ("euclidean", "cosine", "inner_product")
#: Rows of a block of queries and of base rows, and numbers in their vectors, at most.
BLOCK, BLOCK_VALUES = 65_536, 1 << 22


def _stacked(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.asarray(v, float) for v in column]).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, summed in order of dimensions; a zero or non-finite norm counts as 1."""
    n = np.zeros(len(x))
    for d in range(x.shape[1]):
        n += x[:, d] * x[:, d]
    n = np.sqrt(n)
    return x / np.where(np.isfinite(n) & (n > 0), n, 1.0)[:, None]


def stretches(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which stretch, place) of each element of stretches that start at `first` and have `count` elements."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _pair_distances(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of q to the rows of b beside them, summed over dimensions in order, as a SQL fold does."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        if metric == "euclidean":
            diff = q[:, d] - b[:, d]
            out += diff * diff
        else:
            out += q[:, d] * b[:, d]
    if metric == "euclidean":
        return np.sqrt(out)
    return np.maximum(0.0, 1.0 - out) if metric == "cosine" else 1.0 - out


class Search:
    """The exact k nearest of blocks of base rows, by products of matrices.

    Products in single precision tell each distance within a bound, so rows that may be among the nearest are those whose least
    distance isn't beyond the k-th largest; only their distances are summed in double precision, dimension by dimension, and ordered
    by (distance, id). Base rows are kept by group, and by length within it. Held at once: QUERIES x ROWS products, and pairs that may count.
    """

    QUERIES, ROWS, PIECE = 256, 4_096, 4_096

    def __init__(self, q: np.ndarray, qid: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int, metric: str = "euclidean", exclude_self: bool = False, qpart: np.ndarray | None = None, bpart: np.ndarray | None = None, group: np.ndarray | None = None):
        if metric == "cosine":
            q, b = _units(q), _units(b)
        self.k, self.metric = k, metric
        fine, known = np.isfinite(q).all(axis=1), np.isfinite(b).all(axis=1)
        x, y = np.where(fine[:, None], q, 0.0), np.where(known[:, None], b, 0.0)
        if metric == "euclidean":
            middle = (y / max(1, len(y))).sum(axis=0)
            x, y = x - middle, y - middle  # near zero, differences of squares lose less
        top = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
        scale = 2.0 ** min(500.0, -np.ceil(np.log2(top))) if 0 < top < np.inf else 1.0
        x, y = x * scale, y * scale
        self.nq, ny = np.sqrt(np.square(x).sum(axis=1)), np.sqrt(np.square(y).sum(axis=1))
        order = np.lexsort((ny,) if group is None else (ny, group))
        y, self.nb, self.b, self.bid, self.known = y[order], ny[order], b[order], bid[order], known[order]
        self.q, self.qid, self.qpart, self.bpart, self.fine = q, qid, qpart, None if bpart is None else bpart[order], fine
        self.group = None if group is None else group[order]
        self.rounding = (q.shape[1] + 8) * 2.0**-24 * 1.05
        self.least = 1e-30 if metric == "euclidean" else 2.0**-48 * scale**2  # 1 - dot is rounded, and a cosine's distance is cut at 0
        if metric == "euclidean":
            self.left = np.concatenate([-2 * x, np.ones((len(x), 1))], axis=1).astype(np.float32)
            self.right = np.concatenate([y, np.square(self.nb)[:, None]], axis=1).astype(np.float32)
        else:
            self.left, self.right = (-x).astype(np.float32), y.astype(np.float32)
        if exclude_self:  # where each query's id is among the base rows
            by = np.argsort(self.bid, kind="stable")
            lo, hi = (np.searchsorted(self.bid, qid, side, sorter=by) for side in ("left", "right"))
            which, at = stretches(lo, hi - lo)
            self.own_first, self.own = np.concatenate([[0], np.cumsum(hi - lo)]), by[at]
        self.exclude_self = exclude_self

    def _bound(self, rows: np.ndarray, start: int, stop: int) -> np.ndarray:
        """How far the products of queries and a stretch of base rows may be from distances (squared, less the query's own square)."""
        reach = self.nb[start:stop].max(initial=0.0)
        if self.metric == "euclidean":
            return self.rounding * (2 * self.nq[rows] * reach + reach**2) + self.least + 2.0**-46 * (self.nq[rows] + reach) ** 2
        return self.rounding * self.nq[rows] * reach + self.least

    def _bar(self, g: np.ndarray, rows: np.ndarray, start: int, stop: int) -> None:
        """Infinitely far: rows that aren't finite, the query itself, rows of the query's part."""
        if not self.known[start:stop].all():
            g[:, ~self.known[start:stop]] = np.inf
        if self.exclude_self:
            which, at = stretches(self.own_first[rows], self.own_first[rows + 1] - self.own_first[rows])
            at = self.own[at]
            here = (at >= start) & (at < stop)
            g[which[here], at[here] - start] = np.inf
        if self.qpart is not None:
            g[self.qpart[rows][:, None] == self.bpart[None, start:stop]] = np.inf

    def _best(self, r: np.ndarray, c: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs (place in rows, base row) the k nearest of each, in order, as (place, base row, distance)."""
        pieces = [slice(a, a + self.PIECE) for a in range(0, len(r), self.PIECE)]
        d = np.concatenate([_pair_distances(self.q[rows[r[p]]], self.b[c[p]], self.metric) for p in pieces]) if pieces else np.empty(0)
        ok = np.isfinite(d)
        r, c, d = r[ok], c[ok], d[ok]
        order = np.lexsort((self.bid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        size = np.bincount(r, minlength=len(rows))
        keep = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) < self.k
        return r[keep], c[keep], d[keep]

    def nearest(self, rows: np.ndarray, parts: list[tuple[np.ndarray | None, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, base row, distance) of the nearest; parts: (which of `rows` look, None for all; the stretch of base rows that they look at)."""
        fine = np.flatnonzero(self.fine[rows])
        k, cut = self.k, np.full(len(rows), np.inf)  # the k-th nearest so far is at most this far
        pool = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]  # place in rows, base row, least and most that its distance can be
        held, kept = 0, 0

        def prune() -> None:
            nonlocal held, kept
            r, c, low, high = (np.concatenate(x) for x in zip(*pool))
            order = np.lexsort((high, r))
            size = np.bincount(r, minlength=len(rows))
            full = np.flatnonzero(size >= k)
            cut[full] = np.minimum(cut[full], high[order[(np.cumsum(size) - size)[full] + k - 1]])
            keep = low <= cut[r]
            r, c, low, high = r[keep], c[keep], low[keep], high[keep]
            if len(r) > len(rows) * max(64, 4 * k):  # more are equally near, as far as single precision tells
                key = r * len(self.bid) + c
                o = np.argsort(key)
                r, c, _ = self._best(r, c, rows)
                at = o[np.searchsorted(key, r * len(self.bid) + c, sorter=o)]
                low, high = low[at], high[at]
            pool[:] = [(r, c, low, high)]
            held = kept = len(r)

        for mine, start, stop in parts:
            own = fine if mine is None else mine[self.fine[rows[mine]]]
            if not len(own):
                continue
            left = self.left[rows[own]]
            for a in range(start, stop, self.ROWS):
                z = min(a + self.ROWS, stop)
                g = left @ self.right[a:z].T
                self._bar(g, rows[own], a, z)
                bound, limit = self._bound(rows[own], a, z), cut[own]
                fresh = np.isinf(limit)
                if fresh.any() and z - a > k:
                    limit[fresh] = np.partition(g if fresh.all() else g[fresh], k - 1, axis=1)[:, k - 1] + bound[fresh]
                    cut[own] = limit
                limit = np.nextafter(np.minimum(limit + bound, 3e38).astype(np.float32), np.float32(np.inf))
                at = np.flatnonzero(g <= limit[:, None])
                r, c = at // (z - a), at % (z - a)
                d = g[r, c].astype(float)
                pool.append((own[r], c + a, d - bound[r], d + bound[r]))
                held += len(r)
                if held > 2 * kept + len(rows) * k:
                    prune()
        prune()
        r, c, d = self._best(pool[0][0], pool[0][1], rows)
        return rows[r], c, d

    def edges(self, parts_of) -> pd.DataFrame:
        """(i, j, dist) of all queries, a stretch of them after another; parts_of(rows): where they look."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for a in range(0, len(self.qid), self.QUERIES):
            rows = np.arange(a, min(a + self.QUERIES, len(self.qid)))
            out.append(self.nearest(rows, parts_of(rows)))
        i, j, d = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"i": self.qid[i].astype(np.int64), "j": self.bid[j].astype(np.int64), "dist": d})


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "dist": np.empty(0)})


def _nearest(k: int, metric: str, exclude_self: bool, apart: bool):
    def run(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return _nothing()
        part = lambda df: df["part"].to_numpy() if apart else None
        search = Search(_stacked(q["vec"]), q["id"].to_numpy(), _stacked(b["vec"]), b["id"].to_numpy(), k, metric, exclude_self, part(q), part(b))
        return search.edges(lambda rows: [(None, 0, len(b))])

    return run


def top_k(edges: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k edges of each i, ranked anew; by (dist, j) unless told otherwise."""
    w = Window.partitionBy("i").orderBy(*(order or ("dist", "j")))
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "rank", "j", "dist")


def _blocks(spark: SparkSession, q: tuple[int, int | None], b: tuple[int, int | None]) -> tuple[int, int]:
    """Into how many blocks both sides, of (rows, numbers a vector), are dealt."""
    least = lambda rows, wide: max(1, -(-rows // max(1, min(BLOCK, BLOCK_VALUES // max(1, wide or 1)))))
    nq, nb = least(*q), least(*b)
    while nq * nb < min(partitions(spark), 4 * spark.sparkContext.defaultParallelism):
        nq, nb = (nq + 1, nb) if nq * b[0] <= nb * q[0] else (nq, nb + 1)
    return nq, nb


def block_pairs(q: DataFrame, b: DataFrame, kernel, schema: str, by: str | None = None) -> DataFrame:
    """kernel(key, query rows, base rows) over every pair of a block of q and a block of b, within each value of `by`: each pair a task of bounded size. Both have an id and a vec.

    Rows are sent once a block of the other side, so there are as few blocks as BLOCK and BLOCK_VALUES and the use of all cores allow, about as many on either side.
    """
    spark = q.sparkSession

    size = lambda df: df.agg(F.count("*"), F.max(F.size("vec"))).first()
    of_b = size(b)
    nq, nb = _blocks(spark, of_b if q is b else size(q), of_b)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.withColumn("qb", own(nq)).withColumn("bb", spread(nb))
    right = b.withColumn("bb", own(nb)).withColumn("qb", spread(nq))
    right = right.toDF(*right.columns)  # apart from left, which may stem from the same tables
    key = [*([by] if by else []), "qb", "bb"]
    left, right = (x.repartition(nq * nb, *key) for x in (left, right))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(kernel, schema)


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = False, apart: str | None = None) -> DataFrame:
    """Exact k nearest base rows (id, vec) of each query (id, vec): edges (i, rank, j, dist).

    Distances: Euclidean; cosine max(0, 1 - dot of unit vectors, a zero vector as it is); inner_product
    1 - dot. Ties go to the smaller id. exclude_self leaves out equal ids; apart names a column whose
    value must differ on both sides (folds). Rows with a null id or vector take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    prepare(spark)
    part = F.col(apart).cast("long") if apart else F.lit(0).cast("long")
    shaped = lambda df: df.select(
        F.col("id").cast("long").alias("id"), vec.doubles(F.col("vec")).alias("vec"), part.alias("part")
    ).where("id is not null and vec is not null")
    q, b = shaped(queries), shaped(base)
    kernel = _nearest(k, metric, exclude_self, apart is not None)
    met = block_pairs(q, q if queries is base else b, kernel, "i long, j long, dist double")
    return top_k(met, k)


def knn_graph(rows: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """Each row's k nearest other rows; k is cut to n - 1."""
    return knn_join(rows, rows, k, metric, exclude_self=True)


def filtered_knn(rows: DataFrame, allowed: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """Neighbours only from the allowed ids (landmarks)."""
    return knn_join(rows, rows.join(allowed.select("id").distinct(), "id", "left_semi"), k, metric, exclude_self=True)


def nearest(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(i, j, dist): the nearest base row of each query."""
    return knn_join(queries, base, 1).select("i", "j", "dist")


def ivf_centroids(rows: DataFrame, lists: int | None = None, steps: int = 8, seed: int = 4, sample: int = 65_536) -> np.ndarray:
    """Centroids by Lloyd's steps on a sample: all rows, or of more than `sample` rows about as many, those whose ids hash lowest."""
    n = rows.count()
    lists = lists or min(4096, max(1, int(np.ceil(np.sqrt(n)))))
    key = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    picked = rows.select(key.alias("key"), "id", vec.doubles(F.col("vec")).alias("vec")).where(F.col("key") < int((1 << 40) * min(1.0, sample / max(1, n)))).toArrow()
    x = picked["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(picked.num_rows, -1) if picked.num_rows else np.zeros((0, 0))
    x = x[np.lexsort((picked["id"].to_numpy(), picked["key"].to_numpy()))]
    c = x[:lists].copy()
    for _ in range(steps):
        near = np.concatenate([((c**2).sum(axis=1)[None] - 2 * x[a : a + 2048] @ c.T).argmin(axis=1) for a in range(0, len(x), 2048)])
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(axis=0)
    return c


def _listed(k: int, exclude_self: bool):
    """As _nearest, of base rows in lists and queries that look into `lists` of them only."""

    def run(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return _nothing()
        search = Search(_stacked(q["vec"]), q["id"].to_numpy(), _stacked(b["vec"]), b["id"].to_numpy(), k, "euclidean", exclude_self, group=b["list"].to_numpy())
        known = np.unique(search.group)
        first, last = np.searchsorted(search.group, known, "left"), np.searchsorted(search.group, known, "right")
        asked = q["lists"].to_numpy()

        def parts(rows: np.ndarray) -> list[tuple[np.ndarray | None, int, int]]:
            which = np.repeat(np.arange(len(rows)), [len(asked[r]) for r in rows])
            at = np.concatenate([asked[r] for r in rows])
            place = np.minimum(np.searchsorted(known, at), len(known) - 1)
            there = known[place] == at
            which, place = which[there], place[there]
            if len(which) == len(rows) * len(known):
                return [(None, 0, len(b))]
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(len(known) + 1))
            return [(which[order[x:y]], first[n], last[n]) for n, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y]

        return search.edges(parts)

    return run


def ivf_join(queries: DataFrame, base: DataFrame, k: int, centroids: np.ndarray, probes: int, exclude_self: bool = False) -> DataFrame:
    """Approximate Euclidean k nearest: every base row is indexed by its nearest centroid, a query looks into its nearest `probes` lists.

    The centroids are few (at most 4,096) and broadcast. Base rows are dealt to blocks by list (a crowded list to several), and a query goes
    once to each block that holds lists of its own, with their numbers, however many they are; distances within lists are exact.
    """
    spark = queries.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(centroids)
    probes = min(probes, len(centroids))
    shaped = lambda df: df.select(F.col("id").cast("long").alias("id"), vec.doubles(F.col("vec")).alias("vec")).where("id is not null and vec is not null")

    def distances(x: np.ndarray) -> np.ndarray:
        c = shared.value
        return (c**2).sum(axis=1)[None] - 2 * x @ c.T

    def listed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pdf.assign(list=distances(_stacked(pdf["vec"])).argmin(axis=1))

    b = written(shaped(base).mapInPandas(listed, "id long, vec array<double>, list long"), "ivf")
    lists = sorted((r.list, r.n) for r in b.groupBy("list").agg(F.count("*").alias("n")).collect())  # at most 4,096 rows
    wide, n = centroids.shape[1], sum(c for _, c in lists)
    if not n:
        return spark.createDataFrame([], "i long, rank int, j long, dist double")
    nq, nb = _blocks(spark, (queries.count(), wide), (n, wide))
    size = -(-n // nb)  # rows of a block: lists follow one another, and are cut where a block ends
    starts = np.cumsum([0] + [c for _, c in lists])
    table = spark.createDataFrame([(int(v), int(c), int(s)) for (v, c), s in zip(lists, starts)], "list long, _n long, _start long")
    b = b.join(F.broadcast(table), "list").withColumn("bb", ((F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_n"))) / size).cast("int"))
    held = [[v for (v, c), s in zip(lists, starts) if s < (x + 1) * size and s + c > x * size] for x in range(nb)]
    place = spark.sparkContext.broadcast([np.isin(np.arange(len(centroids)), h) for h in held])

    def asked(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), 1_024):
                some = pdf.iloc[a : a + 1_024]
                d = distances(_stacked(some["vec"]))
                mine = np.ones(d.shape, bool)
                if probes < d.shape[1]:
                    mine[:] = False
                    np.put_along_axis(mine, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
                for bb, here in enumerate(place.value):
                    own = mine & here
                    at = np.flatnonzero(own.any(axis=1))
                    if len(at):
                        yield some.iloc[at].assign(bb=bb, lists=[np.flatnonzero(own[r]).astype(np.int32) for r in at])

    block = F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")
    q = shaped(queries).mapInPandas(asked, "id long, vec array<double>, bb int, lists array<int>").withColumn("qb", block)
    b = b.select("id", "vec", "list", "bb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    q = q.toDF(*q.columns)  # apart from b, which may stem from the same tables
    q, b = (x.repartition(nq * nb, "qb", "bb") for x in (q, b))
    return top_k(q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(_listed(k, exclude_self), "i long, j long, dist double"), k)


def tuned_probes(rows: DataFrame, k: int, centroids: np.ndarray, target: float = 0.99, pilot: int = 128) -> tuple[int, float]:
    """The fewest probes whose recall on a pilot (the rows whose ids hash lowest) reaches the target, and that recall.

    A search finds a true neighbour if and only if the neighbour's list is among those it looks into, so the
    place of each true neighbour's list in the query's order of lists gives the recall for every number of probes.
    """
    some = written(rows.orderBy(F.xxhash64("id"), "id").limit(pilot).select("id", "vec"), "pilot")
    exact = written(knn_join(some, rows, k, exclude_self=True), "exact")
    wanted = exact.select(F.col("i").alias("id")).union(exact.select("j")).distinct()
    near = rows.select("id", vec.doubles(F.col("vec")).alias("vec")).join(wanted, "id", "left_semi").collect()  # at most pilot * (k + 1) rows
    place, own = {}, {}
    for r in near:
        order = np.argsort((centroids**2).sum(axis=1) - 2 * centroids @ np.array(r.vec), kind="stable")
        place[r.id] = np.argsort(order, kind="stable")
        own[r.id] = order[0]
    ranks = np.sort([place[r.i][own[r.j]] + 1 for r in exact.collect()])
    if not len(ranks):
        return 1, 1.0
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)])
    return probes, float((ranks <= probes).mean())


def normalize_graph(edges: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """Edges (i, rank, j, dist) without self-loops, non-finite distances and unknown ends; distances at least 0; the first k by stored rank."""
    ok = edges.where("i is not null and j is not null and i <> j and dist is not null and not isnan(dist) and abs(dist) < double('infinity')")
    if nodes is not None:
        ids = nodes.select(F.col("id"))
        ok = ok.join(ids.withColumnRenamed("id", "j"), "j", "left_semi").join(ids.withColumnRenamed("id", "i"), "i", "left_semi")
    return top_k(ok.withColumn("dist", F.greatest("dist", F.lit(0.0))).withColumnRenamed("rank", "was"), k, "was", "j")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(id), in rank order."""
    ids = nodes.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi")
    w = Window.partitionBy("i").orderBy("rank", "j")
    return both.withColumn("rank", F.row_number().over(w)).select("i", "rank", "j", "dist")


def interleave(feature: DataFrame, spatial: DataFrame, k: int) -> DataFrame:
    """Two graphs as one: by source rank, the feature edge first; repeats and self-loops go; dist = source rank / k."""
    both = feature.select("i", "j", "rank", F.lit(0).alias("src")).union(spatial.select("i", "j", "rank", F.lit(1)))
    first = both.where("i <> j").groupBy("i", "j").agg(F.min(F.struct("rank", "src")).alias("key"))
    w = Window.partitionBy("i").orderBy("key", "j")
    out = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("i", "rank", "j", (F.col("key.rank") / F.lit(float(k))).alias("dist"))


def import_sparse(entries: DataFrame, k: int, similarity: bool = False) -> DataFrame:
    """Sparse entries (i, j, value, pos) as a graph: similarity s is distance 1 - min(max(s, 0), 1); self-loops go; k nearest, ties by position, then j."""
    d = 1.0 - F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0)) if similarity else F.col("value").cast("double")
    rows = entries.where("i <> j").withColumn("dist", d)
    return top_k(rows, k, "dist", "pos", "j")
