"""Validation, label encoding, normalisation and scaling of feature rows (id, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vec as V
from tessera.functions.table import beside, medians, numbered

NORMALIZATIONS = ("pqn", "sum", "median", "sqrt", "none")
SCALINGS = ("none", "centering", "autoscaling", "rangescaling", "paretoscaling")
_NAN = float("nan")


def validate(rows: DataFrame, finite: bool = True) -> tuple[int, int]:
    """(rows, columns); ValueError on no rows, null ids or vectors, ragged vectors or, if asked, non-finite cells."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = rows.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("id").isNull() | F.col("vec").isNull(), 1)).alias("null"),
        F.min(F.size("vec")).alias("least"),
        F.max(F.size("vec")).alias("most"),
        F.count(F.when(bad, 1)).alias("bad"),
    ).first()
    if not r.n:
        raise ValueError("no rows")
    if r.null:
        raise ValueError(f"{r.null} rows without id or vector")
    if r.least != r.most or not r.most:
        raise ValueError(f"vectors have {r.least} to {r.most} columns")
    if finite and r.bad:
        raise ValueError(f"{r.bad} rows with values that aren't finite")
    return r.n, r.most


def encode_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds code: 1..K by sorted distinct label. The codes are few and joined, so no window holds all rows."""
    known = rows.select(label).where(F.col(label).isNotNull()).distinct()
    codes = known.withColumn("code", F.row_number().over(Window.orderBy(label)))  # one row a class
    return rows.join(codes, label, "left")


def l2_normalize(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", V.unit(V.doubles(F.col("vec"))))


def median(v: Column) -> Column:
    """Exact median of an array without its NaNs; the middle two are averaged."""
    s = F.array_sort(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(s)
    lo, hi = F.get(s, ((n - 1) / 2).cast("int")), F.get(s, (n / 2).cast("int"))
    return F.when(n == 0, F.lit(_NAN)).otherwise((lo + hi) / 2)


def _known(v: Column) -> Column:
    return F.filter(v, lambda x: ~F.isnan(x))


def _divided(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: _ieee(x, by))


def _ieee(a: Column, b: Column) -> Column:
    """a / b as floating point does it: by zero an infinity or NaN."""
    inf = F.lit(float("inf"))
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(_NAN)).otherwise(F.when(a > 0, inf).otherwise(-inf))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _absolute_sum(v: Column) -> Column:
    return V.total(F.transform(_known(v), F.abs))


def normalize(train: DataFrame, method: str = "pqn", test: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(id, part, vec, coef): rows of train, then of test, divided by their coefficient.

    pqn: rows over their absolute sum (NaN skipped), then over the median quotient with the reference, the
    column medians of the scaled train rows (or reference(c, v)); coef is the product. sum: train's signed
    sum, NaN if a cell is; test's absolute sum, NaN skipped. median: train's is NaN if a cell is, test's
    skips NaN. sqrt: the Euclidean norm. none: 1. Division by zero follows floating point.
    """
    if method not in NORMALIZATIONS:
        raise ValueError(f"method must be one of {NORMALIZATIONS}")
    v = F.col("vec")
    rows = train.select("id", F.lit("train").alias("part"), V.doubles(F.col("vec")).alias("vec"))
    if test is not None:
        rows = rows.union(test.select("id", F.lit("test"), V.doubles(F.col("vec"))))
    is_train = F.col("part") == "train"
    if method == "pqn":
        sums = _absolute_sum(v)
        scaled = rows.withColumn("s", sums).withColumn("vec", _divided(v, F.col("s")))
        if reference is None:
            known = scaled.where(is_train).select(F.posexplode("vec").alias("c", "v")).where(~F.isnan("v"))
            reference = medians(known)
        ref = reference.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"]).alias("ref"))  # one value a column
        quotients = F.zip_with("vec", "ref", _ieee)
        out = scaled.transform(beside, ref).withColumn("q", median(quotients))
        return out.select("id", "part", _divided(v, F.col("q")).alias("vec"), (F.col("q") * F.col("s")).alias("coef"))
    any_nan = F.exists(v, lambda x: F.isnan(x))
    nan = F.lit(_NAN)
    coef = {
        "sum": F.when(is_train, F.when(any_nan, nan).otherwise(V.total(v))).otherwise(_absolute_sum(v)),
        "median": F.when(is_train & any_nan, nan).otherwise(median(v)),
        "sqrt": F.when(is_train, F.when(any_nan, nan).otherwise(V.norm(v))).otherwise(V.norm(_known(v))),
        "none": F.lit(1.0),
    }[method]
    return rows.withColumn("coef", coef).select("id", "part", _divided(v, F.col("coef")).alias("vec"), "coef")


def column_stats(rows: DataFrame) -> DataFrame:
    """(c, n, mean, sd, low, high) of every column, one partial aggregation."""
    long = rows.select(F.posexplode(V.doubles(F.col("vec"))).alias("c", "v"))
    return long.groupBy("c").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))


def scale(train: DataFrame, method: str = "autoscaling", test: DataFrame | None = None) -> DataFrame:
    """(id, part, vec): minus train's column means, over train's scales; the mean is the centre of range scaling too.

    Scales: sd (n - 1), its root for pareto, max - min for range. A constant column gives infinities and NaN.
    """
    if method not in SCALINGS:
        raise ValueError(f"method must be one of {SCALINGS}")
    rows = train.select("id", F.lit("train").alias("part"), V.doubles(F.col("vec")).alias("vec"))
    if test is not None:
        rows = rows.union(test.select("id", F.lit("test"), V.doubles(F.col("vec"))))
    if method == "none":
        return rows
    by = {"centering": F.lit(1.0), "autoscaling": F.col("sd"), "rangescaling": F.col("high") - F.col("low"), "paretoscaling": F.sqrt("sd")}[method]
    fit = column_stats(train).select("c", "mean", by.alias("scale"))
    fit = fit.agg(F.array_sort(F.collect_list(F.struct("c", "mean", "scale"))).alias("fit"))  # one value a column
    out = F.zip_with("vec", "fit", lambda x, f: _ieee(x - f["mean"], f["scale"]))
    return rows.transform(beside, fit).select("id", "part", out.alias("vec"))


def gram(rows: DataFrame) -> DataFrame:
    """(a, b, v), a <= b: sums of products of columns, added up per partition first."""
    v = V.doubles(F.col("vec"))
    left = rows.select(v.alias("vec"), F.posexplode(v).alias("a", "x"))
    both = left.select("a", "x", F.posexplode("vec").alias("b", "y")).where("a <= b")
    return both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def first_dims(rows: DataFrame, d: int) -> DataFrame:
    return rows.withColumn("vec", F.slice("vec", 1, d))


def renumber(groups: DataFrame, *keys: str) -> DataFrame:
    """(id, grp): the groups of equal keys, numbered from 1 by their first id."""
    first = groups.groupBy(*keys).agg(F.min("id").alias("first"))
    number = numbered(first, "first", name="grp")
    same = [groups[k].eqNullSafe(number[k]) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return groups.join(number, cond).select(groups["id"], number["grp"].cast("long").alias("grp"))
