"""Matrix sources and sinks: Parquet, raw binary, NPZ, column mappings, synthetic manifolds."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vec as V
from tessera.session import prepare


def read_matrix(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Parquet columns under the names that operators take, e.g. {"id": "vec_id", "vec": "embedding"}; only these are read."""
    df = spark.read.parquet(path)
    return df if mapping is None else df.select(*(F.expr(e).alias(name) for name, e in mapping.items()))


def write_raw(rows: DataFrame, path: str, dtype: str = "float32") -> None:
    """rows(id, vec) as raw row-major binary in the parts of a Parquet-listed folder: one blob for each stretch of rows, with its first ids."""
    prepare(rows.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.array(pdf["vec"].tolist(), dtype).reshape(len(pdf), -1)
            yield pd.DataFrame({"rows": [len(x)], "cols": [x.shape[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [x.tobytes()]})

    rows.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec")).mapInPandas(run, "rows long, cols long, ids binary, data binary").write.mode("overwrite").parquet(path)


def read_blobs(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(id, vec) of what write_raw wrote."""
    prepare(spark)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                yield pd.DataFrame({"id": np.frombuffer(r.ids, np.int64), "vec": list(np.frombuffer(r.data, dtype).reshape(r.rows, r.cols).astype(float))})

    return spark.read.parquet(path).mapInPandas(run, "id long, vec array<double>")


def read_raw(spark: SparkSession, path: str, cols: int, dtype: str = "float64") -> DataFrame:
    """(id, vec) of raw row-major files without a header; ids number the rows of all files by path."""
    prepare(spark)
    width = cols * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    sizes = sorted((r.path, r.length // width) for r in files.select("path", "length").collect())  # one row a file
    first = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist(), strict=True))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                x = np.frombuffer(r.content, dtype).reshape(-1, cols).astype(float)
                yield pd.DataFrame({"id": first[r.path] + np.arange(len(x)), "vec": list(x)})

    return files.mapInPandas(run, "id long, vec array<double>")


def read_npz(spark: SparkSession, path: str, key: str = "data") -> DataFrame:
    """(id, vec) of the array `key` of NPZ files; ids number the rows within a file."""
    return npz_rows(spark.read.format("binaryFile").load(path), key)


def npz_rows(files: DataFrame, key: str = "data") -> DataFrame:
    """files(content) -> (id, vec) of the array `key` of each."""
    prepare(files.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                x = np.load(io.BytesIO(r.content), allow_pickle=False)[key].astype(float)
                yield pd.DataFrame({"id": np.arange(len(x)), "vec": list(x)})

    return files.select("content").mapInPandas(run, "id long, vec array<double>")


@dataclass
class Container:
    """What operators take from an annotated table: features(id, vec), points(id, sample, vec) and labels(id, label), if there are any, names(id, name)."""

    features: DataFrame
    points: DataFrame | None
    labels: DataFrame | None
    names: DataFrame | None = None


def container(table: DataFrame, id: str, vec: str, coordinates: tuple[str, ...] = (), sample: str | None = None, label: str | None = None, dims: int | None = None) -> Container:
    """The relations of a table of observations whose columns have names of their own. dims: the first dimensions of vec; ValueError if a row has fewer, or lacks a coordinate."""
    cut = F.slice(V.doubles(F.col(vec)), 1, dims) if dims else V.doubles(F.col(vec))
    if dims and not table.where(F.col(vec).isNull() | (F.size(vec) < dims)).isEmpty():
        raise ValueError(f"fewer than {dims} dimensions")
    points = None
    if coordinates:
        if not table.where(" or ".join(f"`{c}` is null" for c in coordinates)).isEmpty():
            raise ValueError("rows without coordinates")
        points = table.select(F.col(id).alias("id"), (F.col(sample) if sample else F.lit(0)).alias("sample"), F.array(*(F.col(c).cast("double") for c in coordinates)).alias("vec"))
    labels = table.select(F.col(id).alias("id"), F.col(label).alias("label")) if label else None
    return Container(table.select(F.col(id).alias("id"), cut.alias("vec")), points, labels)


def single_cell(reductions: DataFrame, reduction: str, dims: int | None = None, images: DataFrame | None = None) -> Container:
    """reductions(reduction, cell, vec[, place]), images(image, cell, x, y): the named reduction's cells, numbered from 0 in order of their place in the container (where none is
    told, of their names), with their coordinates, an image a sample.

    ValueError if there is no such reduction, it has fewer dimensions, or a cell is in no image. A cell in several images counts in the one that sorts last.
    """
    from tessera.functions.table import numbered

    own = reductions.where(F.col("reduction") == reduction)
    if own.isEmpty():
        known = sorted(r.reduction for r in reductions.select("reduction").distinct().limit(100).collect())
        raise ValueError(f"no reduction {reduction}; there are {', '.join(known)}")
    order = ["place", "cell"] if "place" in own.columns else ["cell"]
    rows = numbered(own.select("vec", *order), *order).withColumn("id", (F.col("number") - 1).cast("long"))
    if images is not None:
        place = images.groupBy("cell").agg(F.max_by(F.struct("image", "x", "y"), "image").alias("at"))
        rows = rows.join(place, "cell", "left").select("id", "cell", "vec", F.col("at.image").alias("sample"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))
    out = container(rows, "id", "vec", ("x", "y") if images is not None else (), "sample" if images is not None else None, dims=dims)
    out.names = rows.select("id", F.col("cell").alias("name"))
    return out


def cells_of_counts(counts: DataFrame, cell: str, gene: str, n: str) -> DataFrame:
    """Long counts -> (id = cell, vec): a dense vector of all genes in order of their names, 0 where a cell has none. One array of genes is broadcast."""
    from tessera.functions.table import beside

    genes = counts.select(F.col(gene).alias("g")).where("g is not null").distinct().agg(F.array_sort(F.collect_list("g")).alias("genes"))
    own = counts.where(F.col(gene).isNotNull()).groupBy(F.col(cell).alias("id"), F.col(gene).alias("g")).agg(F.sum(F.col(n).cast("double")).alias("n"))
    own = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("m"))
    return own.transform(beside, genes).select("id", F.transform("genes", lambda g: F.coalesce(F.col("m")[g], F.lit(0.0))).alias("vec"))


def transpose(rows: DataFrame) -> DataFrame:
    """(id = column, vec = that column by row id)."""
    long = rows.select("id", F.posexplode(V.doubles(F.col("vec"))).alias("c", "v"))
    return long.groupBy(F.col("c").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda p: p["v"]).alias("vec"))


def top_features(rows: DataFrame, n: int, rank: str) -> DataFrame:
    """The rows whose stored rank is among the n first."""
    return rows.orderBy(rank).limit(n)


MANIFOLDS = ("dini", "helicoid", "spirals", "swiss_roll")


def manifold(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """(id, vec) on a deterministic grid of n points; spirals add label, three arms."""
    t = F.col("id") / F.lit(float(max(1, n - 1)))
    s = F.pmod(F.col("id") * 7919, F.lit(n)) / F.lit(float(n))
    rows = spark.range(n)
    if kind == "dini":
        u, v = 4 * np.pi * t, 0.01 + 0.98 * s
        return rows.select("id", F.array(F.cos(u) * F.sin(v), F.sin(u) * F.sin(v), F.cos(v) + F.log(F.tan(v / 2)) + 0.2 * u).alias("vec"))
    if kind == "helicoid":
        u, v = 4 * np.pi * t - 2 * np.pi, 2 * s - 1
        return rows.select("id", F.array(v * F.cos(u), v * F.sin(u), u).alias("vec"))
    if kind == "swiss_roll":
        u = 1.5 * np.pi * (1 + 2 * t)
        return rows.select("id", F.array(u * F.cos(u), 21.0 * s, u * F.sin(u)).alias("vec"))
    if kind == "spirals":
        arm = F.pmod("id", F.lit(3))
        r = 0.1 + 0.9 * t
        a = 4 * np.pi * t + 2 * np.pi * arm / 3
        return rows.select("id", F.array(r * F.cos(a), r * F.sin(a)).alias("vec"), (arm + 1).cast("int").alias("label"))
    raise ValueError(f"kind must be one of {MANIFOLDS}")
