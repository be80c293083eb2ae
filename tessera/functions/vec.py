"""Column expressions on vectors (array<double>); sums run in index order, so they are reproducible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(v: Column) -> Column:
    """v over its norm; a zero or non-finite norm counts as 1."""
    n = norm(v)
    ok = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    scale = F.when(ok, n).otherwise(F.lit(1.0))
    return F.transform(v, lambda x: x / scale)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def cells(df, id_col: str = "id", vec_col: str = "vec"):
    """Long form (id, c, v)."""
    return df.select(id_col, F.posexplode(vec_col).alias("c", "v"))


def vectors(long, id_col: str = "id"):
    """Long form back to (id, vec), by c."""
    pairs = F.array_sort(F.collect_list(F.struct("c", "v")))
    return long.groupBy(id_col).agg(F.transform(pairs, lambda p: p["v"]).alias("vec"))
