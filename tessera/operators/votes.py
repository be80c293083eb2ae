"""Votes, accuracies, confusion, class transitions, objective and cross-validated KNN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.table import beside
from tessera.session import written

from .knn import knn_join


def vote(neighbours: DataFrame) -> DataFrame:
    """neighbours(id, label, score) -> (id, label): most votes, then the largest score sum (to 9 digits), then the smallest label."""
    n = neighbours.groupBy("id", "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 9).alias("s"))
    best = F.max(F.struct("n", "s", (-F.col("label")).alias("m")))
    return n.groupBy("id").agg(best.alias("b")).select("id", (-F.col("b.m")).alias("label"))


def majority(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, label): the most frequent label, ties to the smallest."""
    n = rows.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg((-F.max(F.struct("n", (-F.col("label")).alias("m")))["m"]).alias("label"))


def fold_fallback(rows: DataFrame) -> DataFrame:
    """rows(id, label, fold) -> (fold, label): the majority label of all other folds. Classes x folds rows meet, not rows."""
    by = rows.groupBy("fold", "label").agg(F.count("*").alias("n"))
    folds = by.select("fold").distinct()
    total = by.groupBy("label").agg(F.sum("n").alias("n"))
    every = folds.transform(beside, total)  # folds x classes
    own = by.withColumnRenamed("n", "own")
    rest = every.join(own, ["fold", "label"], "left").select("fold", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    return rest.groupBy("fold").agg((-F.max(F.struct("n", (-F.col("label")).alias("m")))["m"]).alias("label"))


def accuracy(rows: DataFrame, by: str | None = None) -> DataFrame:
    """rows(truth, pred[, by]) -> (by or null, n, accuracy); with by, its rows and the total (by null)."""
    right = F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy")
    if by is None:
        return rows.agg(F.count("*").alias("n"), right)
    return rows.rollup(by).agg(F.count("*").alias("n"), right)


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, pred, n) over the labels that occur as truth."""
    known = rows.select(F.col("truth").alias("pred")).distinct()
    return rows.groupBy("truth", "pred").agg(F.count("*").alias("n")).join(known, "pred", "left_semi").select("truth", "pred", "n")


def transitions(rows: DataFrame) -> DataFrame:
    """rows(id, label, pred, fixed) -> (label, pred, n, movable): counts between classes, of all and of movable rows."""
    return rows.groupBy("label", "pred").agg(F.count("*").alias("n"), F.count(F.when(~F.col("fixed"), 1)).alias("movable"))


def absorption_candidates(rows: DataFrame) -> DataFrame:
    """rows(label, pred) -> (source, target, n, surplus): for each class the other class its rows are predicted
    as beyond chance, n - size(a) size(b) / all, where more go there than stay; largest surplus, ties to the smaller label."""
    n = rows.groupBy(F.col("label").alias("source"), F.col("pred").alias("target")).agg(F.count("*").alias("n"))
    size = rows.groupBy(F.col("label").alias("source")).agg(F.count("*").alias("size"))
    total = size.agg(F.sum("size").alias("total"))
    stay = n.where("source = target").select("source", F.col("n").alias("stay"))
    t = n.where("source <> target").join(size, "source").join(size.withColumnRenamed("source", "target").withColumnRenamed("size", "target_size"), "target")
    t = t.join(stay, "source", "left").transform(beside, total)
    t = t.withColumn("surplus", F.col("n") - F.col("size") * F.col("target_size") / F.col("total")).where("n > coalesce(stay, 0) and surplus > 0")
    w = Window.partitionBy("source").orderBy(F.desc(F.round("surplus", 9)), "target")  # one row a pair of classes
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "target", "n", "surplus")


def objective(rows: DataFrame) -> DataFrame:
    """rows(truth, pred) -> (classes, accuracy, diversity, cost, guarded, fragmented, both).

    guarded = accuracy * sqrt(1 - sum p^2), minus infinity (null) for one class. cost is what a split into
    many classes costs: max(H / ln n, f / (1 + f)) with f = ln(K / exp(H)), 0 for one class. fragmented =
    accuracy - (1 - accuracy) * cost, and both = guarded - (1 - accuracy) * cost, null for one class.
    """
    by = rows.groupBy("truth").agg(F.count("*").alias("n"), F.count(F.when(F.col("truth") == F.col("pred"), 1)).alias("right"))
    s = by.agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.log("n")).alias("nlog"))
    acc = F.col("right") / F.col("n")
    div = 1 - F.col("sq") / (F.col("n") * F.col("n"))
    h = F.greatest(F.log("n") - F.col("nlog") / F.col("n"), F.lit(0.0))
    f = F.greatest(F.log("classes") - h, F.lit(0.0))
    code = F.when(F.col("n") > 1, F.least(h / F.when(F.col("n") > 1, F.log("n")).otherwise(1.0), F.lit(1.0))).otherwise(0.0)
    cost = F.when(F.col("classes") > 1, F.greatest(code, f / (1 + f))).otherwise(0.0)
    s = s.select("classes", acc.alias("accuracy"), div.alias("diversity"), cost.alias("cost"))
    many, minus = F.col("classes") > 1, (1 - F.col("accuracy")) * F.col("cost")
    s = s.withColumn("guarded", F.when(many, F.col("accuracy") * F.sqrt(F.greatest("diversity", F.lit(0.0)))))
    return s.withColumn("fragmented", F.col("accuracy") - minus).withColumn("both", F.col("guarded") - minus)


def cv_neighbours(graph: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """A graph's edges whose ends lie in different folds, the first k of each row: (i, rank, j, dist).

    With folds(run, id, fold), the same within each run, of its rows: (run, i, rank, j, dist).
    """
    run = ["run"] if "run" in folds.columns else []
    f = lambda c: folds.select(*run, F.col("id").alias(c), F.col("fold").alias(f"{c}_fold"))
    ok = graph.join(f("i"), "i").join(f("j"), [*run, "j"]).where("i_fold <> j_fold")
    w = Window.partitionBy(*run, "i").orderBy("rank", "j")
    return ok.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(*run, "i", F.col("r").alias("rank"), "j", "dist")


def predict(neighbours: DataFrame, labels: DataFrame, folds: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id, fold, truth, pred): votes of neighbours' labels; rows without neighbours get the majority of the other folds.

    A vote's score is -dist^2 (Euclidean) or 1 - dist. Neighbours are reused for any labels.
    """
    score = -F.col("dist") * F.col("dist") if metric == "euclidean" else 1 - F.col("dist")
    votes = neighbours.join(labels.select(F.col("id").alias("j"), "label"), "j").select(F.col("i").alias("id"), "label", score.alias("score"))
    pred = vote(votes).withColumnRenamed("label", "pred")
    rows = labels.select("id", "label").join(folds, "id")
    rest = fold_fallback(rows).withColumnRenamed("label", "fallback")
    out = rows.join(pred, "id", "left").join(F.broadcast(rest), "fold", "left")  # one row a fold
    return out.select("id", "fold", F.col("label").alias("truth"), F.coalesce("pred", "fallback").alias("pred"))


def knn_cv(rows: DataFrame, folds: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """rows(id, vec, label), folds(id, fold): every row predicted from the k nearest rows of the other folds, all folds in one join."""
    folds = written(folds, "folds")
    both = written(rows.select("id", "vec").join(folds, "id"), "rows")
    near = knn_join(both, both, k, metric, apart="fold")
    return predict(near, rows, folds, metric)
