"""Many optimised labelings, and the graph corrected by how far they agree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.table import beside
from tessera.session import written

from .graph import balanced_regions, laplacian_features, spanning_components, undirected
from .kmeans import kmeans
from .knn import interleave, knn_graph
from .optimizer import CYCLE, Options, optimize
from .preprocess import renumber
from .sampling import landmarks
from .spatial import grid_knn, jitter, jitter_width, landmark_strata, repair_singletons, separate_samples
from .votes import cv_neighbours, majority


def project_labels(graph: DataFrame, known: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """nodes(id), known(id, label) -> (id, label) of the nodes without a label.

    A node takes the majority label of its first k labelled neighbours; without any, that of its first
    neighbour which has some (that neighbour's vote); else the majority of all. Ties to the smaller label.
    With known(run, id, label), the same within each run: (run, id, label).
    """
    run = ["run"] if "run" in known.columns else []
    every = majority(known.select(*(run or [F.lit(1).alias("run")]), "label"), "run").withColumnRenamed("label", "most")
    each = nodes.select("id").transform(beside, every.select("run")) if run else nodes.select("id")  # one row a run
    rest = each.join(known.select(*run, "id"), [*run, "id"], "left_anti")
    edges = graph.join(known.select(*run, F.col("id").alias("j"), "label"), "j")
    w = Window.partitionBy(*run, "i").orderBy("rank", "j")
    first = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(*run, F.col("i").alias("id"), "label")
    votes = written(majority(first, *run, "id"), "votes")
    direct = rest.join(votes, [*run, "id"]).select(*run, "id", "label")
    lone = rest.join(votes, [*run, "id"], "left_anti")
    hop = graph.join(lone.withColumnRenamed("id", "i"), "i").join(votes.select(*run, F.col("id").alias("j"), "label"), [*run, "j"])
    hop = hop.groupBy(*run, F.col("i").alias("id")).agg(F.min_by("label", F.struct("rank", "j")).alias("label"))
    last = lone.join(hop, [*run, "id"], "left")
    last = last.join(F.broadcast(every), "run") if run else last.transform(beside, every.drop("run"))
    return direct.union(last.select(*run, "id", F.coalesce("label", "most").alias("label")))


def dissimilarity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """graph(i, rank, j, dist), labels(run, id, label; 0 is missing) -> (i, rank, j, dist, valid, same).

    With a the share of runs with both labels in which they are equal, dist becomes (1 + dist) / a^2,
    infinity where no run agrees; rows are ranked anew by (dist, j). Labels are gathered once a node (one
    number a run), so an edge brings two arrays together instead of a row for each run.
    """
    packed = labels.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("run", "label"))).alias("m"))  # one entry a run
    of = lambda c: packed.select(F.col("id").alias(c), F.col("m").alias(f"m_{c}"))
    e = graph.join(of("i"), "i", "left").join(of("j"), "j", "left")
    pairs = F.map_filter("m_i", lambda r, x: (x != 0) & (F.coalesce(F.col("m_j")[r], F.lit(0)) != 0))
    e = e.withColumn("p", pairs).withColumn("valid", F.coalesce(F.size(F.map_keys("p")), F.lit(0)))
    e = e.withColumn("valid", F.greatest("valid", F.lit(0)))
    e = e.withColumn("same", F.coalesce(F.size(F.map_keys(F.map_filter("p", lambda r, x: x == F.col("m_j")[r]))), F.lit(0))).withColumn("same", F.greatest("same", F.lit(0)))
    a = F.col("same") / F.when(F.col("valid") > 0, F.col("valid")).otherwise(1)
    d = F.when(F.col("same") == 0, F.lit(float("inf"))).otherwise((1 + F.col("dist")) / (a * a))
    w = Window.partitionBy("i").orderBy("dist", "j")
    return e.select("i", "j", d.alias("dist"), "valid", "same").withColumn("rank", F.row_number().over(w)).select("i", "rank", "j", "dist", "valid", "same")


def spatial_groups(points: DataFrame, clusters: int, resolution: float = 0.3, mode: int = 0, seed: int = 1234, constrain: DataFrame | None = None) -> DataFrame:
    """points(id, sample, vec) -> (id, grp): neighbourhoods that share a fold and move together, none across samples.

    mode 0: k-means of jittered coordinates into `clusters`; 1: components of the lightest neighbour edges down
    to as many; -1: connected regions of at least 1 / resolution rows within each sample. Regions are cut by
    sample, and a region of one row joins its nearest larger one. With constrain(id, grp), a constraint group
    goes whole to the region of most of its rows (within a sample).
    """
    if "sample" not in points.columns:
        points = points.withColumn("sample", F.lit(0))
    apart = written(separate_samples(points), "points")
    n = apart.count()
    if mode == 0:
        near = written(grid_knn(apart.drop("sample"), min(20, n), exclude_self=False), "near")
        moved = jitter(apart.drop("sample"), jitter_width(apart, near, min(20, n)), seed)
        found = kmeans(moved, max(1, min(clusters, n)), 10, seed)[0].withColumnRenamed("cluster", "region")
    else:
        near = grid_knn(apart if mode < 0 else apart.drop("sample"), max(1, min(32, n - 1)))
        edges = written(undirected(near.select("i", "j", F.col("dist").alias("w"))), "edges")
        found = balanced_regions(edges, apart, resolution) if mode < 0 else spanning_components(edges, apart, clusters).withColumnRenamed("component", "region")
    cut = written(renumber(found.join(apart.select("id", "sample"), "id"), "sample", "region"), "regions")
    whole = repair_singletons(apart.join(cut.withColumnRenamed("grp", "cluster"), "id"))
    if constrain is None:
        return whole.select("id", F.col("cluster").cast("long").alias("grp"))
    own = whole.select("id", F.col("cluster").alias("label")).join(constrain.select("id", "grp"), "id").join(apart.select("id", "sample"), "id")
    return written(own.select("id", "sample", "grp").join(majority(own, "sample", "grp"), ["sample", "grp"]), "groups").select("id", F.col("label").cast("long").alias("grp"))


def run_ensemble(
    rows: DataFrame,
    runs: int = 100,
    cycles: int = 20,
    take: int = 10_000,
    splitting: int = 0,
    neighbours: int = 100,
    folds: int = 5,
    k: int = 30,
    seed: int = 1234,
    classifier: str = "knn",
    graph: DataFrame | None = None,
    start: DataFrame | None = None,
    constrain: DataFrame | None = None,
    fixed: DataFrame | None = None,
    spatial: DataFrame | None = None,
    resolution: float = 0.3,
    mode: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(id, vec) -> (labels(run, id, label), runs(CYCLE), graph with agreement).

    The graph is built once; every run draws its landmarks (three quarters of fewer rows than `take`) by
    strata, labels them by cluster, optimises, and projects the labels to all rows; members of a constraint
    group get their group's majority. With spatial(id, sample, vec), landmarks are drawn by grid cells, the
    graph takes turns with the spatial one, and neighbourhoods (see spatial_groups) are constraint groups. Runs are tasks of their own, bounded by their landmarks.
    """
    n = rows.count()
    if n < 3:
        raise ValueError("at least three rows")
    size = max(2, min(n - 1, math.ceil(0.75 * n) if n <= take else take))
    width = max(1, min(size, int(0.75 * n) - 1, neighbours))
    clusters = splitting or (100 if n < 40_000 else 300)
    if graph is None:
        graph = written(knn_graph(rows, width), "graph")
    if spatial is not None:
        strata = written(landmark_strata(spatial, size), "strata")
        near = written(grid_knn(spatial, width), "spatial_graph")
        graph = written(interleave(graph, near, width), "graph")
    initial, _ = kmeans(rows, max(2, min(clusters, n // 2)), 10, seed)
    initial = written(initial.select("id", F.col("cluster").cast("long").alias("label")), "strata")
    if spatial is None:
        strata = initial.select("id", F.col("label").alias("stratum"))
    if start is not None:
        initial = start.select("id", F.col("label").cast("long").alias("label"))
    if spatial is not None:
        constrain = written(spatial_groups(spatial, max(1, round(size * resolution)), resolution, mode, seed, constrain), "groups")
    groups = constrain.select("id", F.col("grp").cast("long").alias("grp")) if constrain is not None else rows.select("id", F.col("id").cast("long").alias("grp"))
    frozen = fixed.select("id", "fixed") if fixed is not None else rows.select("id", F.lit(False).alias("fixed"))
    base = initial.join(groups, "id").join(frozen, "id").join(rows.select("id", "vec"), "id")
    picked = landmarks(strata, size, seed, runs=runs).select("run", "id")
    fold = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("run")).cast("string"), F.col("grp").cast("string")))
    fold = F.pmod(F.conv(F.substring(fold, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    own = written(picked.join(base, "id").withColumn("fold", fold), "landmarks")
    edges = cv_neighbours(graph, own.select("run", "id", "fold"), k)
    parts = own.select("run", "id", "label", "grp", "fixed", "fold", *(["vec"] if classifier != "knn" else []))
    o = Options(cycles=cycles, evolutionary=start is None, diversity=True, absorption=True, coarsening=classifier != "knn", classifier=classifier, k=k, folds=folds, seed=seed)
    found = written(optimize(parts, edges, o), "runs")
    best = found.where("best").select("run", "id", "label")
    labels = best.union(project_labels(graph, best, rows, k))
    if constrain is not None:
        labels = labels.join(groups, "id")
        labels = labels.select("run", "id", "grp").join(majority(labels, "run", "grp"), ["run", "grp"]).select("run", "id", "label")
    labels = written(labels.select("run", "id", "label"), "labels")
    return labels, found.where("not best").select(*CYCLE), dissimilarity(graph, labels)


def graph_only_ensemble(graph: DataFrame, nodes: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An ensemble of a graph without features: its Laplacian features take their place."""
    rows = written(laplacian_features(graph, nodes), "features")
    return run_ensemble(rows, graph=graph, **options)
