"""Operators on coordinates: rows (id, vec) or (id, sample, vec) with vec of two or three dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vec as V
from tessera.functions.table import beside
from tessera.session import bounded, prepare, written

from .knn import _nearest, block_pairs, top_k
from .preprocess import column_stats
from .stats import beta_tail

#: Least p-value kept, and the clip of Cauchy combinations.
P_FLOOR, P_CLIP = 1e-300, 1e-15
#: Rows of cells' blocks that meet queries in a task.
BLOCK = 4_096


def separate_samples(rows: DataFrame) -> DataFrame:
    """Shifts the first coordinate so that samples, in id order, lie side by side, half a sample's width apart.

    With m, M a sample's least and greatest x, the next offset is the offset + M + (M - m) / 2. One sample: unchanged.
    """
    x = F.get("vec", 0)
    ends = rows.groupBy("sample").agg(F.min(x).alias("low"), F.max(x).alias("high"))
    w = Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)  # one row a sample
    offsets = ends.select("sample", F.coalesce(F.sum(F.col("high") + 0.5 * (F.col("high") - F.col("low"))).over(w), F.lit(0.0)).alias("offset"))
    moved = F.transform("vec", lambda v, i: F.when(i == 0, v + F.col("offset")).otherwise(v))
    return rows.join(F.broadcast(offsets), "sample").select("id", "sample", moved.alias("vec"))


def grid_cells(rows: DataFrame, bins: int) -> DataFrame:
    """Adds cell: one bin number a dimension, bins of equal width over each dimension's range, clamped."""
    s = column_stats(rows).select("c", "low", "high")
    s = s.agg(F.array_sort(F.collect_list(F.struct("c", "low", "high"))).alias("box"))  # one value a dimension
    width = lambda b: (b["high"] - b["low"]) / bins
    cell = F.zip_with("vec", "box", lambda x, b: F.when(width(b) > 0, F.least(F.lit(bins - 1), F.floor((x - b["low"]) / width(b)).cast("int"))).otherwise(0))
    return rows.transform(beside, s).withColumn("cell", cell).drop("box")


def landmark_strata(rows: DataFrame, target: int, dims: int = 2) -> DataFrame:
    """(id, stratum): grid cells of about one landmark each, within samples if rows have them."""
    cells = grid_cells(rows, max(1, math.ceil(target ** (1 / dims))))
    parts = [F.array_join(F.transform("cell", lambda c: F.format_string("%06d", c)), ",")]
    if "sample" in rows.columns:
        parts.insert(0, F.col("sample").cast("string"))
    return cells.select("id", F.concat_ws(":", *parts).alias("stratum"))


def grid_knn(rows: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Exact Euclidean k nearest rows in one to three dimensions (within the sample, if rows have one).

    Cells of levels, each twice as wide as those before, are counted once. A row whose cell at some level holds
    enough rows has its k nearest within that cell's diagonal, which is less than a cell of the next level: it
    looks into its cell and the adjoining ones there, and into nothing else. So each row asks once, at a level
    of its own, and cells hold few rows; crowded ones (equal points) are split in blocks.
    """
    spark = rows.sparkSession
    prepare(spark)
    sample = F.col("sample").cast("string") if "sample" in rows.columns else F.lit("")
    points = rows.select(F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec"), sample.alias("sample"), F.lit(0).cast("long").alias("part"))
    stats = sorted(column_stats(points).collect(), key=lambda r: r.c)  # one row a dimension
    if not stats:
        return spark.createDataFrame([], "i long, rank int, j long, dist double")
    dims, n = len(stats), max(r.n for r in stats)
    if dims > 3:
        raise ValueError("at most three dimensions")
    spans = [r.high - r.low for r in stats]
    volume = math.prod(s if s > 0 else 1.0 for s in spans)
    cell = max(1e-300, max(spans) / 2**40, (volume * max(1, k) / n) ** (1 / dims) / 2)
    low = F.array(*(F.lit(r.low) for r in stats))
    top = max(1, math.ceil(math.log2(max(spans) / cell + 2)))
    base = written(points.withColumn("fine", F.transform("vec", lambda x, i: F.floor((x - F.get(low, i)) / F.lit(cell)))), "points")
    at = lambda level: F.expr(f"transform(fine, c -> shiftright(c, {level}))")  # noqa: E731  the cell of a level

    counted = base.groupBy("sample", "fine").agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))
    each = counted.withColumn("level", levels).withColumn("cell", at("level"))
    sizes = each.groupBy("sample", "level", "cell").agg(F.sum("n").alias("held"))
    enough = each.join(sizes, ["sample", "level", "cell"]).where(F.col("held") >= k + int(exclude_self))
    level = enough.groupBy("sample", "fine").agg(F.min("level").alias("least"))
    level = counted.join(level, ["sample", "fine"], "left").select("sample", "fine", F.least(F.coalesce("least", F.lit(top)) + 1, F.lit(top)).alias("level"))

    # cells meet in tiles of 4 a side: a row asks in its own tile, and is held by each tile with a cell next to its own
    level = written(level, "levels")
    steps = F.array(*(F.array(*map(F.lit, s)) for s in np.ndindex(*(3,) * dims)))
    tile = F.expr("transform(fine, c -> shiftright(c, level + 2))")
    tiles = F.transform(steps, lambda s: F.transform(F.zip_with(at("level"), s, lambda a, b: a + b - 1), lambda c: F.shiftright(c, 2)))
    asked = level.select("sample", "level", tile.alias("tile")).distinct()
    used = level.select("level").distinct().agg(F.array_sort(F.collect_list("level")).alias("used"))  # at most top + 1 levels
    held_by = lambda x: x.transform(beside, used).withColumn("level", F.explode("used")).withColumn("tile", F.explode(F.array_distinct(tiles)))
    key = ["sample", "level", "tile"]
    blocks = held_by(counted).join(asked, key).groupBy(*key).agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    parts = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    ask = base.join(level, ["sample", "fine"]).withColumn("tile", tile).join(blocks, key)
    ask = ask.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).withColumn("block", F.explode(parts))
    held = held_by(base).join(blocks, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("salt", F.explode(parts))
    group = [*key, "block", "salt"]
    ask, held = (x.select(*group, "id", "vec", "part") for x in (ask, held))
    ask = ask.toDF(*ask.columns)  # apart from held, which stems from the same tables
    kernel = _nearest(k, "euclidean", exclude_self, False)
    met = ask.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(lambda key, a, b: kernel(key, a, b), "i long, j long, dist double")
    return top_k(met, k)


def jitter_width(rows: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(c, width): 3 / n times the sum over rows of |coordinate of the nearest - of the 20th| neighbour, in a graph whose first neighbour is the row itself."""
    at = max(1, min(20, k))
    long = rows.select(F.col("id").alias("j"), F.posexplode(V.doubles(F.col("vec"))).alias("c", "v"))
    pick = graph.where(F.col("rank").isin(1, at)).join(long, "j")
    gap = pick.groupBy("i", "c").agg(F.max(F.when(F.col("rank") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("rank") == at, F.col("v"))).alias("b"))
    n = rows.agg(F.count("*").alias("n"))
    return gap.groupBy("c").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("s")).transform(beside, n).select("c", (3 * F.col("s") / F.col("n")).alias("width"))


def hashed_uniform(seed: int, *columns: str | Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the columns: 52 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def jitter(rows: DataFrame, widths: DataFrame, seed: int) -> DataFrame:
    """Coordinates moved by a uniform step within each dimension's width; replayed by the seed."""
    w = widths.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "width"))), lambda p: p["width"]).alias("w"))  # one value a dimension
    move = F.transform("vec", lambda x, i: x + F.get("w", i) * (2 * hashed_uniform(seed, F.col("id"), i) - 1))
    return rows.transform(beside, w).withColumn("vec", move).drop("w")


def pass_messages(rows: DataFrame, features: DataFrame, k: int = 15) -> DataFrame:
    """(id, vec): for each row the sum over its k nearest rows of the sample, itself among them, of exp(-d / D) times their features.

    D is the sample's largest neighbour distance (weights exp(0) if it is 0). ValueError if a sample has fewer than k rows.
    """
    if "sample" not in rows.columns:
        rows = rows.withColumn("sample", F.lit(0))
    short = rows.groupBy("sample").count().where(F.col("count") < k).first()
    if short:
        raise ValueError(f"sample {short[0]} has fewer than {k} rows")
    near = grid_knn(rows, k, exclude_self=False).join(rows.select(F.col("id").alias("i"), "sample"), "i")
    scale = near.groupBy("sample").agg(F.max("dist").alias("D"))
    near = near.join(F.broadcast(scale), "sample")
    near = near.withColumn("w", F.exp(F.when(F.col("D") > 0, -F.col("dist") / F.col("D")).otherwise(0.0)))
    long = features.select(F.col("id").alias("j"), F.posexplode(V.doubles(F.col("vec"))).alias("c", "v"))
    out = near.join(long, "j").groupBy(F.col("i").alias("id"), "c").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return V.vectors(out)


def repair_singletons(rows: DataFrame) -> DataFrame:
    """rows(id, sample, vec, cluster) -> (id, cluster): a cluster of one row joins the nearest row's of a larger cluster in its sample."""
    prepare(rows.sparkSession)
    size = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    s = rows.join(size, "cluster").select(F.col("id").cast("long").alias("id"), V.doubles(F.col("vec")).alias("vec"), "sample", "size")
    s = written(s, "sized")
    near = top_k(block_pairs(s.where("size = 1"), s.where("size > 1"), _nearest(1, "euclidean", False, False), "i long, j long, dist double", "sample"), 1)
    to = near.join(rows.select(F.col("id").alias("j"), F.col("cluster").alias("to")), "j").select(F.col("i").alias("id"), "to")
    return rows.join(to, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))


def regularize_population(rows: DataFrame, seed: int = 1, steps: int = 200, most: int = 5_000) -> DataFrame:
    """(id, vec): repeated locations pulled apart and evened out; two dimensions, at least two locations.

    Locations (at most `most`, checked) move by attraction to their three nearest and repulsion of strength 2,
    clipped at 5, at rate 0.01, until they move less than 1e-4; radii and spacing are then equalised.
    """
    dims = rows.select(F.max(F.size("vec"))).first()[0]
    if dims != 2:
        raise ValueError("exactly two dimensions")
    places = rows.groupBy("vec").agg(F.min("id").alias("first"))
    if bounded(places, most, "locations to regularise") < 2:
        raise ValueError("at least two locations")
    found = places.orderBy("first").collect()
    x = np.array([r.vec for r in found], float)
    rng = np.random.default_rng(seed)
    y = x + rng.normal(0, 0.001, x.shape)
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, 1:4]
    for _ in range(steps):
        pull = (y[near] - y[:, None]).sum(axis=1)
        gap = y[:, None] - y[None]
        push = (gap / ((gap**2).sum(axis=2) + 1e-6)[:, :, None]).sum(axis=1)
        move = 0.01 * np.clip(pull + 2.0 * push / len(y), -5, 5)
        y += move
        if np.abs(move).max() < 1e-4:
            break
    y -= y.mean(axis=0)
    r = np.sqrt((y**2).sum(axis=1))
    order = np.argsort(r, kind="stable")
    even = np.empty(len(r))
    even[order] = np.sqrt((np.arange(len(r)) + 0.5) / len(r)) * max(r.max(), 1e-12)  # equal areas
    y *= (even / np.where(r > 0, r, 1))[:, None]
    y += x.mean(axis=0)
    moved = rows.sparkSession.createDataFrame([(list(map(float, a.vec)), list(map(float, b))) for a, b in zip(found, y, strict=True)], "vec array<double>, moved array<double>")
    return rows.withColumn("vec", V.doubles(F.col("vec"))).join(F.broadcast(moved), "vec").select("id", F.col("moved").alias("vec"))


# spatial feature screening

_SCALES = (0.1, 0.2, 0.4, 0.8, 1.6)


def _bases(u: np.ndarray) -> list[np.ndarray]:
    out = [u]
    out += [np.exp(-(u**2) / (2 * s * s)) for s in _SCALES]
    out += [np.concatenate([np.sin(2 * np.pi * u / s), np.cos(2 * np.pi * u / s)], axis=1) for s in _SCALES]
    return out


def _projector(cov: np.ndarray, tol: float) -> np.ndarray:
    """Columns that orthonormalise a basis with these centred products; directions of a norm up to tol are dropped."""
    kept: list[np.ndarray] = []
    for i in range(len(cov)):
        v = np.zeros(len(cov))
        v[i] = 1.0
        for _ in range(2):
            for w in kept:
                v -= (w @ cov @ v) * w
        size = v @ cov @ v
        if size > tol * tol:
            kept.append(v / math.sqrt(size))
    return np.array(kept).reshape(len(kept), len(cov))


def screen_features(rows: DataFrame, require_nonzero: bool = True) -> DataFrame:
    """rows(id, sample, x array, vec) -> (c, p, score, q, rank): which variables vary in space.

    In each sample (at least 8 rows) coordinates are scaled to 0..1 and 11 bases made of them: linear, five
    Gaussian and five periodic ones. A variable's R^2 on a basis of rank d gives p = I_{1-R^2}((n-d-1)/2, d/2).
    p-values are Cauchy combined over bases, then over samples; score is the largest -log10 p. A variable
    that is zero in a whole sample has p 1 and score 0. q is Benjamini-Hochberg's, rank by score.

    The data are read twice: ranges, then one pass of sums of products (bases x variables), added up in
    Spark; what meets on the driver grows with the variables, not with the rows.
    """
    spark = rows.sparkSession
    prepare(spark)
    dims = rows.select(F.max(F.size("x"))).first()[0] or 2
    box = rows.groupBy("sample").agg(F.count("*").alias("n"), *(F.min(F.get("x", d)).alias(f"lo{d}") for d in range(dims)), *(F.max(F.get("x", d)).alias(f"hi{d}") for d in range(dims)))
    found = {r.sample: r for r in box.collect()}  # one row a sample
    small = [s for s, r in found.items() if r.n < 8]
    if small:
        raise ValueError(f"sample {small[0]} has fewer than 8 rows")
    limits = {s: ([r[f"lo{d}"] for d in range(dims)], [r[f"hi{d}"] for d in range(dims)]) for s, r in found.items()}
    shared = spark.sparkContext.broadcast(limits)
    rank = {s: i for i, s in enumerate(sorted(limits))}

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in it:
            for s, own in pdf.groupby("sample"):
                lo, hi = map(np.array, shared.value[s])
                u = (np.array(own["x"].tolist(), float) - lo) / np.where(hi > lo, hi - lo, 1.0)
                y = np.array(own["vec"].tolist(), float)
                if not np.isfinite(y).all() or not np.isfinite(u).all():
                    raise ValueError("values must be finite")
                b = np.concatenate([np.ones((len(u), 1)), *_bases(u)], axis=1)
                part = [b.T @ b, b.T @ y, (y**2).sum(axis=0), (y != 0).sum(axis=0).astype(float)]
                total[s] = [a + p for a, p in zip(total[s], part, strict=True)] if s in total else part
        for s, parts in total.items():
            flat = np.concatenate([p.ravel() for p in parts])
            yield pd.DataFrame({"s": rank[s], "at": np.arange(len(flat)), "v": flat})

    out: dict[int, dict[int, float]] = {}
    for r in rows.select("sample", "x", V.doubles(F.col("vec")).alias("vec")).mapInPandas(sums, "s long, at long, v double").groupBy("s", "at").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault(r.s, {})[r.at] = r.v
    width = 1 + sum(b.shape[1] for b in _bases(np.zeros((1, dims))))
    cauchy = lambda p: float(np.clip(0.5 - math.atan(np.tan((0.5 - np.clip(p, P_CLIP, 1 - P_CLIP)) * math.pi).mean()) / math.pi, P_FLOOR, 1.0))
    per_sample, zero = [], None
    for s in sorted(out):
        flat = np.array([out[s][i] for i in range(len(out[s]))])
        bb = flat[: width * width].reshape(width, width)
        m = (len(flat) - width * width) // (width + 2)
        by = flat[width * width : width * width + width * m].reshape(width, m)
        yy, nonzero = flat[-2 * m : -m], flat[-m:]
        n = bb[0, 0]
        cov, cross, var = bb - np.outer(bb[:, 0], bb[0]) / n, by - np.outer(bb[:, 0], by[0]) / n, yy - by[0] ** 2 / n
        ps, at = [], 1
        for b in _bases(np.zeros((1, dims))):
            own = slice(at, at + b.shape[1])
            at += b.shape[1]
            w = _projector(cov[own, own], 1e-6)
            r2 = np.clip((np.square(w @ cross[own]).sum(axis=0)) / np.where(var > 0, var, 1), 0, 1 - 1e-15) if len(w) else np.zeros(m)
            d = len(w)
            ps.append([max(P_FLOOR, beta_tail(1 - r, (n - d - 1) / 2, d / 2)) if d and v > 1e-12 else 1.0 for r, v in zip(r2, var, strict=True)])
        per_sample.append(np.array(ps))
        zero = (nonzero == 0) if zero is None else zero | (nonzero == 0)
    m = per_sample[0].shape[1]
    result = []
    for c in range(m):
        if require_nonzero and zero[c]:
            result.append((c, 1.0, 0.0))
            continue
        result.append((c, cauchy(np.array([cauchy(s[:, c]) for s in per_sample])), max(float(-np.log10(s[:, c].min())) for s in per_sample)))
    p = np.array([r[1] for r in result])
    order = np.argsort(-p, kind="stable")
    q = np.empty(m)
    q[order] = np.minimum(1, np.minimum.accumulate(p[order] * m / np.arange(m, 0, -1)))
    place = np.empty(m, int)
    place[np.lexsort((np.arange(m), -np.array([r[2] for r in result])))] = np.arange(1, m + 1)
    return spark.createDataFrame([(int(c), float(a), float(s), float(b), int(k)) for (c, a, s), b, k in zip(result, q, place, strict=True)], "c int, p double, score double, q double, rank int")
