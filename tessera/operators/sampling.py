"""Folds, landmarks, ranking and p-value adjustment. Hashes of ids take the place of random numbers."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.table import beside, ranked
from tessera.session import bounded, prepare, written

#: Groups that the greedy fold assignment orders in one task.
MOST_GROUPS = 1_000_000


def shuffled(seed: int, *columns: str):
    """A sort key that shuffles: md5 of the seed and the columns, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def folds(rows: DataFrame, n: int = 10, seed: int = 1, stratified: bool = True) -> DataFrame:
    """(id, fold): shuffled rows dealt in turn; stratified, each label's rows from fold 0 on."""
    if n < 2:
        raise ValueError("at least two folds")
    keyed = rows.select("id", "label") if stratified else rows.select("id")
    dealt = ranked(keyed if stratified else keyed.withColumn("label", F.lit(0)), ["label"], shuffled(seed, "id"), "id")
    return dealt.select("id", F.pmod(F.col("r") - 1, F.lit(n)).cast("int").alias("fold"))


def grouped_folds(rows: DataFrame, n: int = 10, seed: int = 1, stratified: bool = True) -> DataFrame:
    """rows(id, label, grp) -> (id, fold): groups stay whole.

    Groups, the largest first and of one size shuffled, go to the fold of the least load: by rows of the
    group's majority label and then all rows (stratified), or by rows. The greedy pass needs the groups in
    one order: they are counted first, and at most MOST_GROUPS meet in one task.
    """
    if n < 2:
        raise ValueError("at least two folds")
    prepare(rows.sparkSession)
    count = rows.groupBy("grp", "label").agg(F.count("*").alias("n"))
    groups = count.groupBy("grp").agg(F.sum("n").alias("size"), (-F.max(F.struct("n", (-F.col("label")).alias("m")))["m"]).alias("label"))
    bounded(groups, MOST_GROUPS, "groups for the greedy fold assignment")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [hashlib.md5(f"{seed}:{g}".encode()).hexdigest() for g in pdf["grp"]]
        pdf = pdf.assign(key=key).sort_values(["size", "key"], ascending=[False, True])
        load, by_label, out = [0] * n, {}, []
        for size, label in zip(pdf["size"], pdf["label"], strict=True):
            own = by_label.setdefault(label, [0] * n)
            f = min(range(n), key=(lambda i: (own[i], load[i], i)) if stratified else (lambda i: (load[i], i)))  # noqa: B023
            own[f] += size
            load[f] += size
            out.append(f)
        return pd.DataFrame({"grp": pdf["grp"], "fold": out})

    dealt = groups.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda p: deal(p.drop(columns="one")), "grp long, fold int")
    return rows.join(dealt, "grp").select("id", "fold")


def landmarks(rows: DataFrame, target: int, seed: int = 1, offset: float = 0.5, runs: int = 0) -> DataFrame:
    """rows(id, stratum) -> (id, stratum): exactly min(target, n) rows, each stratum its share.

    Quotas are rounded down; the slots left go to the strata whose cumulated fractions pass offset + 0, 1,
    2, ... (systematic rounding), in stratum order. Within a stratum rows are taken in shuffled order. With
    runs, as many independent draws: (run from 1, id, stratum), run r shuffled by seed + r.
    """
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    s = sizes.transform(beside, total).withColumn("t", F.least(F.lit(target), F.col("total")))
    s = s.withColumn("quota", F.floor(F.col("t") * F.col("n") / F.col("total"))).withColumn("rest", F.pmod(F.col("t") * F.col("n"), F.col("total")))  # exact: the fraction is rest / total
    w = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)  # one row a stratum
    s = s.withColumn("cum", F.sum("rest").over(w)).withColumn("lo", F.col("cum") - F.col("rest"))
    at = lambda c: F.ceil(F.col(c) / F.col("total") - F.lit(offset))  # noqa: E731  slots whose place offset + t lies below c
    s = s.withColumn("quota", F.col("quota") + at("cum") - at("lo"))
    if runs:
        each = rows.select("id", "stratum", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
        key = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("run")).cast("string"), F.col("id").cast("string")))
        out = ranked(each, ["run", "stratum"], key, "id")
    else:
        out = ranked(rows.select("id", "stratum"), ["stratum"], shuffled(seed, "id"), "id")
    return out.join(s.select("stratum", "quota"), "stratum").where("r <= quota").select(*(["run"] if runs else []), "id", "stratum")


def covered_landmarks(rows: DataFrame, chosen: DataFrame, seed: int = 1) -> DataFrame:
    """rows(id, grp), chosen(id) -> (id): as many landmarks, every group with one.

    Groups without a landmark get their first row in shuffled order, in place of landmarks of groups with
    more than one (theirs after the first, in shuffled order). ValueError if there are fewer landmarks than groups.
    """
    have = rows.join(chosen.select("id"), "id", "left_semi")
    key = shuffled(seed, "id")
    first = lambda df: df.groupBy("grp").agg(F.min(F.struct(key.alias("k"), "id"))["id"].alias("id")).select("id")
    missing = written(first(rows.join(have.select("grp").distinct(), "grp", "left_anti")), "missing")
    kept = written(first(have), "kept")
    spare = have.select("id").join(kept, "id", "left_anti")
    need, extra = missing.count(), spare.count()
    if need > extra:
        raise ValueError("fewer landmarks than groups")
    return kept.union(missing).union(spare.orderBy(key, "id").limit(extra - need))


def top_by_score(rows: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n rows of the highest score, ties to the smaller id, with their rank. A top-n report: n rows leave each task."""
    best = rows.orderBy(F.desc(score), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def adjust_bh(rows: DataFrame, p: str = "p") -> DataFrame:
    """Adds q: the Benjamini-Hochberg adjusted p-value, min(1, min over larger p of p m / rank).

    Distinct p-values carry counts, ranges of them are numbered and scanned on their own, and a small table
    of the ranges joins them, so no task sorts all rows.
    """
    counts = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p_")).agg(F.count("*").alias("n_"))
    counts = counts.withColumn("range_", F.floor(F.least(F.col("p_"), F.lit(1.0)) * 1024))
    ranges = counts.groupBy("range_").agg(F.sum("n_").alias("size"))
    up = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # 1,025 rows at most
    starts = ranges.select("range_", F.coalesce(F.sum("size").over(up), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("m"))
    w = Window.partitionBy("range_").orderBy("p_")
    c = counts.join(F.broadcast(starts), "range_").withColumn("rank", F.col("start") + F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("raw", F.col("p_") * F.col("m") / F.col("rank"))
    own = F.min("raw").over(w.rowsBetween(0, Window.unboundedFollowing))
    later = c.groupBy("range_").agg(F.min("raw").alias("least"))
    later = later.select("range_", F.min("least").over(Window.orderBy("range_").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    c = c.withColumn("own", own).join(F.broadcast(later), "range_", "left")
    q = c.select("p_", F.least(F.lit(1.0), F.col("own"), F.coalesce("later", F.lit(1.0))).alias("q"))
    return rows.join(q, rows[p] == q["p_"], "left").drop("p_")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
