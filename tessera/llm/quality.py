"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Each class is a Gaussian over the statistics, its covariance shrunk towards the pooled one and that
towards the identity. A score is the logistic of the difference of the two log-densities
(-(Mahalanobis distance)^2 / 2 - half the log-determinant + the log-prior), computed with the
Cholesky factor of each covariance, made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, written
from .text_kernel import LOWER, NOT_SPACE, chunks, joined, word_hashes, words

#: Weight of the pooled covariance, and of the identity (in units of the pooled variances).
POOLED, IDENTITY = 0.1, 0.1

_KIND = np.full(256, 5, np.uint8)  # other marks
_KIND[0x61:0x7B] = _KIND[0x80:] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 9, 11, 12, 13]] = 3
_KIND[[*b".,;:'\"()-?"]] = 4
_KIND[10] = 6

NAMES = (
    "log_bytes", "log_words", "upper", "digits", "spaces", "stops", "marks", "lines", "word_length", "word_spread",
    "distinct_words", "distinct_pairs", "again", "top_word", "marked_words", "line_repeats",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The square root of a share: small ones spread."""
    return np.sqrt(part / np.maximum(whole, 1))


def statistics(column: pa.Array) -> np.ndarray:
    """Texts x statistics; null and empty texts have zeros."""
    out = np.zeros((len(column), len(NAMES)))
    for a, b, data, offsets in chunks(column):
        n = b - a
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        kind = np.bincount(doc * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
        low = LOWER[data]
        starts, ends, first = words(low, offsets, NOT_SPACE)
        h = word_hashes(low, starts, ends)
        length = (ends - starts).astype(float)
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        mean = np.bincount(owner, length, n) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / np.maximum(count, 1) - mean**2, 0))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]) if len(h) else np.zeros(0, bool)
        last = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
        pairs = joined(h, 2)
        line_starts, line_ends, line_first = words(low, offsets, _NOT_BREAK)
        lines = word_hashes(low, line_starts, line_ends)
        distinct, distinct_pairs, top, distinct_lines = (np.zeros(n) for _ in range(4))
        for i in np.flatnonzero(count):
            x, y = first[i], first[i + 1]
            s = np.sort(h[x:y])
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i] = len(cuts) - 1
            top[i] = np.diff(cuts).max()
            s = np.sort(pairs[x : y - 1])
            distinct_pairs[i] = np.count_nonzero(s[1:] != s[:-1]) + (len(s) > 0)
            s = np.sort(lines[line_first[i] : line_first[i + 1]])
            distinct_lines[i] = np.count_nonzero(s[1:] != s[:-1]) + (len(s) > 0)
        out[a:b] = np.stack(
            [
                np.log1p(size), np.log1p(count), _share(kind[:, 1], size), _share(kind[:, 2], size), _share(kind[:, 3], size), _share(kind[:, 4], size),
                _share(kind[:, 5], size), np.log1p(kind[:, 6]), np.log1p(mean), np.log1p(spread), distinct / np.maximum(count, 1), distinct_pairs / np.maximum(count - 1, 1),
                _share(np.bincount(owner, same, n), count), _share(top, count), _share(np.bincount(owner, last == 5, n), count),
                _share(np.diff(line_first) - distinct_lines, np.diff(line_first)),
            ],
            axis=1,
        )
    return out


_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False


@dataclass
class Discriminant:
    """For each of the classes 0 and 1: mean, inverse of the Cholesky factor, constant. None: a class had no rows."""

    mean: list[np.ndarray | None]
    factor: list[np.ndarray | None]
    constant: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; without rows of a class the other's, without rows 1/2."""
        known = [m is not None for m in self.mean]
        if not all(known):
            return np.full(len(x), 1.0 if known[1] else 0.0 if known[0] else 0.5)
        log = [c - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, c in zip(self.mean, self.factor, self.constant, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """From all rows of measured (id, x) with a label 0 or 1: their counts, sums and products, added up in Spark."""
    rows = measured.join(labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)"), "doc_id").select("x", "y")
    p = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.tile(np.arange(total.shape[1]), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(at), pa.array(total.ravel())], ["y", "at", "v"])

    total = np.zeros((2, 1 + p + p * p))
    for r in rows.mapInArrow(sums, "y long, at long, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        total[r.y, r.at] = r.v
    n = total[:, 0]
    mean = [total[k, 1 : 1 + p] / n[k] if n[k] else None for k in (0, 1)]
    if not all(n):
        return Discriminant(mean, [None, None], [0.0, 0.0])
    cov = [total[k, 1 + p :].reshape(p, p) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    ridge = np.diag(IDENTITY * np.diag(pooled) + 1e-6)
    factor, constant = [], []
    for k in (0, 1):
        low = np.linalg.cholesky((1 - POOLED) * cov[k] + POOLED * pooled + ridge)
        factor.append(np.linalg.inv(low))
        constant.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))
    return Discriminant(mean, factor, constant)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): every document's statistics, over its whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, x array<double>"), "statistics")


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, x): the probability of label 1.

    Null and empty texts have statistics of zero and a score like any text. Rows that repeat, or have
    no id, give as many rows; an empty table none. Without labels every score is 1/2.
    """
    prepare(measured.sparkSession)
    p = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), batch.column(1)], ["doc_id", "score", "x"])

    return measured.mapInArrow(run, "doc_id long, score double, x array<double>")
