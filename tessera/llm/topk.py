"""Exact top-k inner-product search, columnar branch and bound.

Vectors lie in vertical layout (one row of memory for each dimension). Scores of a block of queries
are accumulated over one block of dimensions at a time; after each, a candidate is dropped when even
its remaining mass (Cauchy-Schwarz on the dimensions not seen yet) can't lift it to the query's k-th
best score so far, and the survivors are compacted. Scores are integers, exact in float64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import partitions, prepare, written

#: Integers a unit.
SCALE = 64
#: Dimensions accumulated between two prunings.
DIM_BLOCK = 16
#: Queries and candidates handled at once.
QUERY_BLOCK, CANDIDATE_BLOCK = 128, 2_048
#: Queries, and candidates, that meet in one task at most; candidates from which rows are dealt to more tasks.
TASK_QUERIES, TASK_CANDIDATES, LEAST_CANDIDATES = 8_192, 65_536, 4_096
#: Bytes of queries, and of candidates, that meet in one task: longer vectors meet in smaller groups.
TASK_BYTES = 64 << 20
#: Sums beyond it may not be exact in float64.
EXACT = 2.0**52


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Dimensions x rows; shorter vectors are filled with zeros."""
    out = np.zeros((max((len(r) for r in rows), default=0), len(rows)))
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out


def _remaining(m: np.ndarray) -> np.ndarray:
    """The norm of what lies at and beyond each block of dimensions, for each column."""
    blocks = range(0, m.shape[0], DIM_BLOCK)
    return np.sqrt(np.array([np.square(m[b:]).sum(axis=0) for b in blocks] + [np.zeros(m.shape[1])]))


class _Integers:
    """Columns of a matrix as Python's integers, made when they are asked for."""

    def __init__(self, m: np.ndarray):
        self.m, self.held = m, {}

    def __getitem__(self, at: tuple[slice, int]) -> np.ndarray:
        j = int(at[1])
        if j not in self.held:
            if len(self.held) >= CANDIDATE_BLOCK:
                self.held.clear()
            self.held[j] = np.array([int(v) for v in self.m[:, j]], object)
        return self.held[j]


def search(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of each query's k best vectors but its own row, ties to the smaller id. Matrices are dimensions x rows."""
    dims = max(queries.shape[0], vectors.shape[0])
    queries, vectors = (np.pad(m, ((0, dims - m.shape[0]), (0, 0))) for m in (queries, vectors))
    order = np.argsort(ids, kind="stable")
    vectors, ids, rows = vectors[:, order], ids[order], rows[order]
    mass_q, mass_v = _remaining(queries), _remaining(vectors)
    exact = float(mass_q[0].max(initial=0)) * float(mass_v[0].max(initial=0)) < EXACT
    for a in range(0, queries.shape[1], QUERY_BLOCK):
        own, q, mq = query_rows[a : a + QUERY_BLOCK], queries[:, a : a + QUERY_BLOCK], mass_q[:, a : a + QUERY_BLOCK]
        best = np.full((len(own), k), -np.inf) if exact else np.full((len(own), k), None, object)
        best_ids = np.full((len(own), k), np.iinfo(np.int64).max)
        for c in range(0, vectors.shape[1], CANDIDATE_BLOCK):
            at = np.arange(c, min(c + CANDIDATE_BLOCK, vectors.shape[1]))
            if exact:
                score = np.zeros((len(own), len(at)))
                bar = best[:, -1:]
                for n, d in enumerate(range(0, dims, DIM_BLOCK)):
                    score += q[d : d + DIM_BLOCK].T @ vectors[d : d + DIM_BLOCK, at]
                    alive = ((score + mq[n + 1][:, None] * mass_v[n + 1, at] * (1 + 1e-9) + 1e-3) >= bar).any(axis=0)
                    if not alive.all():
                        at, score = at[alive], score[:, alive]
                    if not len(at):
                        break
                score[own[:, None] == rows[at]] = -np.inf
                keep = (score >= bar).any(axis=0) & (score > -np.inf).any(axis=0)
                score, at = score[:, keep], at[keep]
                if not len(at):
                    continue
                if len(at) > 4 * k:  # first cut, ties kept
                    cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    keep = (score >= cut).any(axis=0)
                    score, at = score[:, keep], at[keep]
                every = np.concatenate([best, score], axis=1)
                every_ids = np.concatenate([best_ids, np.broadcast_to(ids[at], score.shape)], axis=1)
                first = np.lexsort((every_ids, -every), axis=-1)[:, :k]
                best, best_ids = np.take_along_axis(every, first, 1), np.take_along_axis(every_ids, first, 1)
            else:  # huge components: Python's integers, of what the norms don't rule out
                big = _Integers(vectors)
                for i in range(len(own)):
                    bar = best[i, -1]
                    x = np.array([int(v) for v in q[:, i]], object)
                    near = at if bar is None else at[float(bar) * (1 - 1e-9 * np.sign(float(bar))) - 1 <= mq[0, i] * mass_v[0, at] * (1 + 1e-9)]
                    new = [(int(x @ big[:, j]), int(ids[j])) for j in near if rows[j] != own[i]]
                    old = [(s, int(v)) for s, v in zip(best[i], best_ids[i], strict=True) if s is not None]
                    top = sorted(old + new, key=lambda t: (-t[0], t[1]))[:k]
                    for n, (s, v) in enumerate(top):
                        best[i, n], best_ids[i, n] = s, v
        for i in range(len(own)):
            real = best[i] > -np.inf if exact else np.array([s is not None for s in best[i]], bool)
            least, most = -(2**63), 2**63 - 1
            yield int(own[i]), best_ids[i][real], np.array([min(most, max(least, int(s))) for s in best[i][real]], np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) as (id, the floored multiples' bytes); null, holding null or non-finite: left out."""
    for batch in batches:
        ids, out, who = batch.column(0), [], []
        for i, v in zip(ids.to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                out.append(np.floor(SCALE * x).tobytes())
                who.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(out, pa.binary())], ["id", "packed"])


def exact_topk(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best rows but its own.

    is_query: a SQL condition on id that picks the queries.

    A component x counts as floor(64 x), x as double; the score is the integer inner product (where
    lengths differ, missing components are 0); ties go to the smaller id; a query has fewer rows if
    there are fewer candidates. Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part; an empty vector scores 0. Rows that repeat an id are rows like others:
    each is a query of its own if its id asks, and a candidate of all others, those of its id included.
    Scores beyond 64 bits are cut to their ends. Other columns are ignored. An empty table gives no rows.

    The stated queries meet all rows in blocks: groups of queries x groups of rows, each pair of
    groups a task of bounded size, whatever the vectors' length.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    packed = rows.mapInArrow(_pack, "id long, packed binary").withColumn("row", F.monotonically_increasing_id())
    packed = written(packed.withColumn("asks", F.coalesce(F.expr(is_query), F.lit(False))), "vectors")
    total = packed.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q"), F.max(F.length("packed")).alias("bytes")).first()
    parts = partitions(spark)
    fit = max(1, TASK_BYTES // max(1, total.bytes or 1))
    groups_q = max(1, -(-total.q // min(TASK_QUERIES, fit)))
    groups_c = max(1, -(-total.n // min(TASK_CANDIDATES, fit)), min(-(-parts // groups_q), -(-total.n // LEAST_CANDIDATES)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id", "row"), F.lit(n)).cast("int")
    ask = packed.where("asks").select(own(groups_q).alias("gq"), "id", "row", "packed", F.lit(True).alias("asks")).withColumn("gc", spread(groups_c))
    have = packed.select(own(groups_c).alias("gc"), "id", "row", "packed", F.lit(False).alias("asks")).withColumn("gq", spread(groups_q))
    both = ask.unionByName(have)

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        ids, at = rows["id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
        m = [np.frombuffer(x) for x in rows["packed"]]
        of = dict(zip(at.tolist(), ids.tolist(), strict=True))
        found = list(search(_matrix([m[i] for i in np.flatnonzero(asks)]), at[asks], _matrix([m[i] for i in np.flatnonzero(~asks)]), ids[~asks], at[~asks], k))
        return pd.DataFrame(
            {
                "row": np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]),
                "query_id": np.repeat(np.array([of[f[0]] for f in found], np.int64), [len(f[1]) for f in found]),
                "vec_id": np.concatenate([np.empty(0, np.int64), *(f[1] for f in found)]),
                "score": np.concatenate([np.empty(0, np.int64), *(f[2] for f in found)]),
            }
        )

    near = both.groupBy("gq", "gc").applyInPandas(best, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
