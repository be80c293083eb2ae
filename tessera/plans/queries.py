"""One query for each operator, over whole tables. Floats are rounded to 6 digits for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import embed, ensemble, graph, kmeans, knn, linalg, metrics, optimizer, preprocess, sampling, spatial, votes
from tessera.session import shared_dir, written
from tessera.sources import matrices

from .inputs import digest, features, points, predictions, read, run_labels, suppliers, traces

QUERIES = {}
K = 15


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(r6(c) if c in cols else F.col(c) for c in df.columns))


def spread(df: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, c, v) of rows with a vec."""
    return df.select("id", *keep, F.posexplode("vec").alias("c", "v")).select("id", *keep, "c", r6("v"))


def self_graph(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return written(knn.knn_graph(features(spark, sf_dir), k), "graph")


# sources


@query
def s1_scan_matrix(spark, sf_dir):
    m = matrices.read_matrix(spark, f"{sf_dir}/embeddings.parquet", {"id": "vec_id", "vec": "cast(embedding as array<double>)"})
    return m.select("id", F.size("vec").cast("long").alias("cols"), r6(F.get("vec", 0), "first"), r6(F.get("vec", 63), "last"))


@query
def s2_gather_rows(spark, sf_dir):
    f = features(spark, sf_dir)
    wanted = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return f.join(wanted, "id", "left_semi").select("id", "label")


@query
def s3_raw_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    matrices.write_raw(features(spark, sf_dir), path)
    return spread(matrices.read_blobs(spark, path))


@query
def s7_import_sparse(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_discount").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return rounded(knn.import_sparse(li, 10, similarity=True), "dist")


@query
def s8_transpose(spark, sf_dir):
    t = matrices.transpose(features(spark, sf_dir))
    return t.select("id", F.size("vec").cast("long").alias("rows"), r6(F.get("vec", 0), "first"))


@query
def s5_npz(spark, sf_dir):
    """The first rows written as NPZ by NumPy into the shared folder, and read by Spark."""
    import io

    import numpy as np

    rows = features(spark, sf_dir).orderBy("id").limit(100).collect()
    blob = io.BytesIO()
    np.savez(blob, data=np.array([r.vec for r in rows]))
    path = f"{shared_dir(spark)}/npz"
    spark.createDataFrame([(bytearray(blob.getvalue()),)], "content binary").write.mode("overwrite").parquet(path)
    return spread(matrices.npz_rows(spark.read.parquet(path)))


@query
def s6_spatial_container(spark, sf_dir):
    """A table of observations with coordinates and slides in columns of their own names, as features, points and labels."""
    f = features(spark, sf_dir)
    table = f.select(F.col("id").alias("obs"), "vec", F.get("vec", 0).alias("x_um"), F.get("vec", 1).alias("y_um"), (F.col("id") % 2).cast("int").alias("slide"), F.col("label").alias("cell_type"))
    got = matrices.container(table, id="obs", vec="vec", coordinates=("x_um", "y_um"), sample="slide", label="cell_type")
    both = got.features.join(got.points.withColumnRenamed("vec", "xy"), "id").join(got.labels, "id")
    return rounded(both.select("id", "sample", "label", F.get("vec", 2).alias("third"), F.get("xy", 0).alias("x"), F.get("xy", 1).alias("y")), "third", "x", "y")


@query
def s8_single_cell_reduction(spark, sf_dir):
    """Two reductions of named cells, of which one is taken, in 8 dimensions, with coordinates from two images."""
    f = features(spark, sf_dir).withColumn("cell", F.format_string("c%05d", F.col("id")))
    both = f.select(F.lit("pca").alias("reduction"), "cell", "vec", F.col("id").alias("place")).union(f.select(F.lit("other"), "cell", F.slice("vec", 1, 3), "id"))
    images = f.select(F.concat(F.lit("slide"), (F.col("id") % 2).cast("string")).alias("image"), "cell", F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"))
    got = matrices.single_cell(both, "pca", 8, images)
    rows = got.names.join(got.features, "id").join(got.points.withColumnRenamed("vec", "xy"), "id")
    return rounded(rows.select("id", "name", "sample", F.size("vec").alias("dims"), F.get("vec", 7).alias("last"), F.get("xy", 0).alias("x"), F.get("xy", 1).alias("y")), "last", "x", "y")


@query
def s8_single_cell_counts(spark, sf_dir):
    """Counts of genes x cells in long form (supplier, quarter, quantity), as cells with a dense vector of the genes in order, absent ones 0."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.concat(F.lit("g"), (F.col("l_partkey") % 6).cast("string")).alias("gene")).agg(F.sum("l_quantity").cast("double").alias("n"))
    return spread(matrices.cells_of_counts(li.where("pmod(cell, 7) > 0 or gene <> 'g3'"), "cell", "gene", "n"))


@query
def s9_first_dims(spark, sf_dir):
    return spread(preprocess.first_dims(features(spark, sf_dir), 8))


@query
def s10_top_features(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.struct(-F.col("p_retailprice"), "p_partkey").alias("r"))
    return matrices.top_features(p, 50, "r").select("p_partkey")


@query
def s11_manifolds(spark, sf_dir):
    out = None
    for kind in matrices.MANIFOLDS:
        m = matrices.manifold(spark, kind, 300).select("id", "vec")
        one = m.select(F.lit(kind).alias("kind"), "id", F.posexplode("vec").alias("c", "v")).select("kind", "id", "c", r6("v"))
        out = one if out is None else out.union(one)
    return out


# projection, normalisation, scaling


@query
def p1_validate(spark, sf_dir):
    n, cols = preprocess.validate(features(spark, sf_dir))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(cols).cast("long").alias("cols"))


@query
def p2_encode_labels(spark, sf_dir):
    return preprocess.encode_labels(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("label"))).select("p_partkey", "code")


@query
def p3_l2_normalize(spark, sf_dir):
    return spread(preprocess.l2_normalize(features(spark, sf_dir)))


def _normalized(method):
    def run(spark, sf_dir):
        s = suppliers(spark, sf_dir)
        train, test = s.where("id % 2 = 0"), s.where("id % 2 = 1")
        n = preprocess.normalize(train, method, test)
        return n.select("id", "part", r6("coef"), F.posexplode("vec").alias("c", "v")).select("id", "part", "coef", "c", r6("v"))

    return run


for _m in ("pqn", "sum", "median", "sqrt"):
    QUERIES[f"p{4 if _m == 'pqn' else 5}_normalize_{_m}"] = _normalized(_m)


def _scaled(method):
    def run(spark, sf_dir):
        s = suppliers(spark, sf_dir)
        return spread(preprocess.scale(s.where("id % 3 > 0"), method, s.where("id % 3 = 0")), "part")

    return run


for _m in ("centering", "autoscaling", "rangescaling", "paretoscaling"):
    QUERIES[f"p6_scale_{_m}"] = _scaled(_m)


@query
def p7_median(spark, sf_dir):
    return features(spark, sf_dir).select("id", r6(preprocess.median(F.col("vec")), "median"))


@query
def p8_renumber_groups(spark, sf_dir):
    f = features(spark, sf_dir)
    return preprocess.renumber(f.select("id", (F.col("id") % 3).alias("sample"), "label"), "sample", "label")


@query
def p9_separate_samples(spark, sf_dir):
    return spread(spatial.separate_samples(points(spark, sf_dir)), "sample")


@query
def p10_jitter_width(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(spatial.jitter_width(p, knn.knn_join(p, p, 20), 20), "width")


@query
def p11_jitter(spark, sf_dir):
    p = points(spark, sf_dir).drop("sample")
    return spread(spatial.jitter(p, spark.createDataFrame([(0, 0.5), (1, 0.25)], "c int, width double"), 3))


@query
def p12_population(spark, sf_dir):
    p = points(spark, sf_dir).select("id", F.transform("vec", lambda x: F.round(8 * x)).alias("vec"))
    return spread(spatial.regularize_population(p))


@query
def p13_grid_cells(spark, sf_dir):
    return spatial.grid_cells(points(spark, sf_dir), 6).select("id", F.get("cell", 0).alias("cx"), F.get("cell", 1).alias("cy"))


# neighbour joins


@query
def j1_knn_euclidean(spark, sf_dir):
    return rounded(knn.knn_graph(features(spark, sf_dir), K), "dist")


@query
def j1_knn_cosine(spark, sf_dir):
    return rounded(knn.knn_graph(features(spark, sf_dir), K, "cosine"), "dist")


@query
def j1_knn_inner_product(spark, sf_dir):
    return rounded(knn.knn_graph(features(spark, sf_dir), K, "inner_product"), "dist")


@query
def j1_knn_train_test(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(knn.knn_join(f.where("id % 4 = 0"), f.where("id % 4 > 0"), 5), "dist")


@query
def j3_ivf(spark, sf_dir):
    f = features(spark, sf_dir)
    c = knn.ivf_centroids(f)
    probes, _ = knn.tuned_probes(f, K, c)
    return rounded(knn.ivf_join(f, f, K, c, probes, exclude_self=True), "dist")


@query
def j3_ivf_every_list(spark, sf_dir):
    """All lists are looked into, so the result is exact."""
    f = features(spark, sf_dir)
    c = knn.ivf_centroids(f)
    return rounded(knn.ivf_join(f, f, K, c, len(c), exclude_self=True), "dist")


@query
def j3_ivf_recall(spark, sf_dir):
    """How many true neighbours there are, and whether the tuned index finds 95 of 100."""
    true = self_graph(spark, sf_dir).select("i", "j")
    found = j3_ivf(spark, sf_dir).select("i", "j", F.lit(1).alias("hit"))
    return true.join(found, ["i", "j"], "left").agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.95 * F.count("*")).alias("reached"))


@query
def j4_filtered_knn(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(knn.filtered_knn(f, f.where("id % 3 = 0"), 5), "dist")


@query
def j5_grid_knn(spark, sf_dir):
    return rounded(spatial.grid_knn(points(spark, sf_dir).drop("sample"), 10), "dist")


@query
def j6_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(knn.nearest(p.where("sample = 1"), p.where("sample = 0")), "dist")


@query
def j7_self_graph_clamped(spark, sf_dir):
    some = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array((F.col("n_nationkey") * 7 % 11).cast("double"), (F.col("n_nationkey") * 5 % 13).cast("double")).alias("vec"))
    return rounded(knn.knn_graph(some, 100), "dist")


@query
def j9_normalize_graph(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    e = li.groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 120).alias("j")).agg(F.round(F.min("l_tax") - 0.04, 6).alias("dist"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return rounded(knn.normalize_graph(e, 5, e.select(F.col("i").alias("id")).distinct()), "dist")


@query
def j10_induced(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(knn.induced(self_graph(spark, sf_dir), f.where("id % 2 = 0")), "dist")


@query
def j11_interleave(spark, sf_dir):
    g = self_graph(spark, sf_dir)
    near = written(knn.knn_graph(points(spark, sf_dir).drop("sample"), K), "near")
    return rounded(knn.interleave(g, near, K), "dist")


@query
def j12_project_labels(spark, sf_dir):
    f = features(spark, sf_dir)
    return ensemble.project_labels(self_graph(spark, sf_dir, 5), f.where("id % 10 = 0").select("id", "label"), f, 5)


# votes and aggregates


@query
def a1_vote(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 7).alias("label"), F.col("l_discount").alias("score"))
    return votes.vote(li)


@query
def a2_majority(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") % 7).alias("label"))
    return votes.majority(li, "grp")


@query
def a3_fold_fallback(spark, sf_dir):
    f = features(spark, sf_dir).select("label", (F.col("id") % 5).alias("fold"))
    return votes.fold_fallback(f)


@query
def a4_accuracy(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int"))
    return rounded(votes.accuracy(p, "fold"), "accuracy")


@query
def a5_confusion(spark, sf_dir):
    return votes.confusion(predictions(spark, sf_dir).where("truth < 8"))


@query
def a6_transitions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return votes.transitions(p.select("id", F.col("truth").alias("label"), "pred", (F.col("id") % 3 == 0).alias("fixed")))


@query
def a7_objective(spark, sf_dir):
    m = votes.objective(predictions(spark, sf_dir))
    return rounded(m, *m.columns[1:])


@query
def c10_objective_of_runs(spark, sf_dir):
    """Three labelings: the predictions', one class only, and a class a row."""
    p = predictions(spark, sf_dir)
    out = None
    for name, rows in (("as_is", p), ("one_class", p.select("id", F.lit(1).alias("truth"), F.lit(1).alias("pred"))), ("a_class_a_row", p.select("id", F.col("id").alias("truth"), (F.col("id") - F.col("id") % 4).alias("pred")))):
        one = votes.objective(rows).select(F.lit(name).alias("labels"), "*")
        out = one if out is None else out.union(one)
    return rounded(out, *out.columns[2:])


@query
def a8_kmeans(spark, sf_dir):
    return kmeans.kmeans(features(spark, sf_dir), 10)[0]


@query
def a8_lloyd_step(spark, sf_dir):
    import numpy as np

    f = features(spark, sf_dir)
    start = np.array([r.vec for r in f.orderBy("id").limit(8).collect()])
    found = written(kmeans.assign(f, start), "assigned")
    long = f.join(found, "id").select("cluster", F.posexplode("vec").alias("c", "v"))
    return long.groupBy("cluster", "c").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


@query
def a9_pass_messages(spark, sf_dir):
    return spread(spatial.pass_messages(points(spark, sf_dir), preprocess.first_dims(features(spark, sf_dir), 4), K))


@query
def a10_column_stats(spark, sf_dir):
    return rounded(preprocess.column_stats(features(spark, sf_dir)), "mean", "sd", "low", "high")


@query
def a10_gram(spark, sf_dir):
    return rounded(preprocess.gram(features(spark, sf_dir)), "v")


@query
def a11_dissimilarity(spark, sf_dir):
    d = ensemble.dissimilarity(self_graph(spark, sf_dir), run_labels(spark, sf_dir))
    return d.select("i", "rank", "j", F.when(F.col("same") > 0, r6("dist")).alias("dist"), "valid", "same")


@query
def a12_components(spark, sf_dir):
    g = self_graph(spark, sf_dir, 2)
    e = g.where("rank = 1").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return graph.components(e, features(spark, sf_dir))


@query
def a13_modularity(spark, sf_dir):
    e = graph.weigh(self_graph(spark, sf_dir), "distance")
    return rounded(graph.modularity(e, features(spark, sf_dir).select("id", "label")), "modularity")


# sampling, ranking, sets


@query
def o1_folds_stratified(spark, sf_dir):
    return sampling.folds(features(spark, sf_dir), 5)


@query
def o1_folds_plain(spark, sf_dir):
    return sampling.folds(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 10, stratified=False)


@query
def o1_folds_grouped(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", F.expr("c_custkey div 7").alias("grp"))
    return sampling.grouped_folds(preprocess.encode_labels(c, "c_mktsegment").select("id", F.col("code").alias("label"), "grp"), 5)


@query
def o2_landmarks(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("stratum"))
    return sampling.landmarks(c, 137)


@query
def o3_grid_landmarks(spark, sf_dir):
    return sampling.landmarks(spatial.landmark_strata(points(spark, sf_dir), 60), 60)


@query
def o4_covered_landmarks(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"))
    return sampling.covered_landmarks(c, c.where("grp % 5 = 0").select("id"))


@query
def o5_top_by_score(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return rounded(sampling.top_by_score(p, 100), "score")


@query
def o6_adjust_bh(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.pow(digest(F.lit("q"), F.col("o_orderkey")) / 65536.0, 3), 9).alias("p"))
    return sampling.adjust_bh(o).select("id", r6("p"), r6("q"))


@query
def o7_undirected_max(spark, sf_dir):
    g = self_graph(spark, sf_dir)
    return rounded(graph.undirected(g.select("i", "j", (1 / (1 + F.col("dist"))).alias("w"))), "w")


@query
def o7_fuzzy_union(spark, sf_dir):
    g = self_graph(spark, sf_dir)
    return rounded(embed.fuzzy_union(g.select("i", "j", (1 / (1 + F.col("dist"))).alias("w"))), "w")


@query
def o8_binary_union(spark, sf_dir):
    return graph.binary_union(self_graph(spark, sf_dir))


def _weights(spark, sf_dir, k=K):
    g = self_graph(spark, sf_dir, k)
    return written(graph.undirected(g.select("i", "j", F.col("dist").alias("w"))), "weights")


@query
def o9_spanning_components(spark, sf_dir):
    return graph.spanning_components(_weights(spark, sf_dir), features(spark, sf_dir), 12)


@query
def o10_balanced_regions(spark, sf_dir):
    return graph.balanced_regions(_weights(spark, sf_dir), features(spark, sf_dir), 0.1)


@query
def o11_repair_singletons(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("cluster", F.when(F.col("id") % 25 == 0, F.col("id") + 1000).otherwise(F.expr("id div 50") * 2 + F.col("sample")).cast("long"))
    return spatial.repair_singletons(p)


# the label optimiser


@query
def c1_knn_cv(spark, sf_dir):
    f = features(spark, sf_dir)
    return votes.knn_cv(f, sampling.folds(f, 10), 10)


@query
def c1_knn_cv_accuracy(spark, sf_dir):
    return rounded(votes.accuracy(c1_knn_cv(spark, sf_dir), "fold"), "accuracy")


@query
def c2_core_knn(spark, sf_dir):
    f = features(spark, sf_dir)
    fold = written(sampling.folds(f, 10, stratified=False), "folds")
    rows = f.join(fold, "id").select(F.lit(1).alias("run"), "id", (F.col("id") % 20).alias("label"), F.expr("id div 2").alias("grp"), F.lit(False).alias("fixed"), "fold")
    near = votes.cv_neighbours(self_graph(spark, sf_dir, 40), fold, 30).withColumn("run", F.lit(1))
    o = optimizer.Options(cycles=30, evolutionary=True, diversity=True, absorption=True)
    return rounded(optimizer.optimize(rows, near, o), "accuracy", "score")


@query
def c2_core_pls_lda(spark, sf_dir):
    f = features(spark, sf_dir)
    fold = written(sampling.folds(f, 5, stratified=False), "folds")
    rows = f.join(fold, "id").select(F.lit(1).alias("run"), "id", (F.col("id") % 8).alias("label"), F.col("id").alias("grp"), F.lit(False).alias("fixed"), "fold", "vec")
    none = spark.createDataFrame([], "i long, rank int, j long, dist double, run int")
    o = optimizer.Options(cycles=6, evolutionary=True, diversity=True, absorption=True, coarsening=True, classifier="pls-lda", components=5)
    return rounded(optimizer.optimize(rows, none, o), "accuracy", "score")


def _holds(spark, facts: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in facts.items()], "invariant string, holds boolean")


def _core_facts(found: DataFrame, rows: DataFrame, again: DataFrame, cycles: int, both: bool) -> dict[str, bool]:
    """What holds of an optimisation of rows(id, label, grp, fixed); again(id, pred): its best labels predicted anew by the engine's distributed operators."""
    found = written(found, "found")
    best = found.where("best").join(rows.select("id", F.col("label").alias("start"), "grp", "fixed"), "id")
    trace = found.where("not best")
    w = Window.orderBy("cycle")
    falls = trace.withColumn("before", F.lag("score").over(w)).where("score < before")
    o = votes.objective(best.select(F.col("label").alias("truth"), "pred")).first()
    one = best.first()
    return {
        "a trace of all cycles": trace.count() == cycles and trace.select("cycle").distinct().count() == cycles,
        "accepted as it improves or by temperature": trace.where("accepted <> (improving or temperature) or (improving and temperature)").isEmpty(),
        "at least two classes": trace.where("active_classes < 2").isEmpty() and best.select("label").distinct().count() > 1,
        "fixed rows keep their labels": best.where("fixed and label <> start").isEmpty(),
        "groups stay whole": best.groupBy("grp").agg(F.countDistinct("label").alias("n")).where("n > 1").isEmpty(),
        "the accuracy is that of the predictions": abs(o.accuracy - one.accuracy) < 1e-9,
        "the best score never falls": falls.isEmpty(),
        "the predictions are those of the best labels": best.select("id", "pred").exceptAll(again.select("id", "pred")).isEmpty(),
        "the score is the objective": abs((o.both if both else o.guarded) - one.score) < 1e-9,
    }


@query
def c2_core_knn_invariants(spark, sf_dir):
    f = features(spark, sf_dir)
    fold = written(sampling.folds(f, 10, stratified=False), "folds")
    grp = F.expr("id div 2")
    rows = written(f.join(fold, "id").select(F.lit(1).alias("run"), "id", (grp % 20).alias("label"), grp.alias("grp"), (grp % 9 == 0).alias("fixed"), "fold"), "rows")
    near = written(votes.cv_neighbours(self_graph(spark, sf_dir, 40), fold, 30), "near")
    found = written(optimizer.optimize(rows, near.withColumn("run", F.lit(1)), optimizer.Options(cycles=25, evolutionary=True, diversity=True, absorption=True)), "found")
    again = votes.predict(near, found.where("best").select("id", "label"), fold)
    return _holds(spark, _core_facts(found, rows, again, 25, False))


@query
def c2_core_pls_lda_invariants(spark, sf_dir):
    f = features(spark, sf_dir)
    fold = written(sampling.folds(f, 5, stratified=False), "folds")
    rows = written(f.join(fold, "id").select(F.lit(1).alias("run"), "id", (F.col("id") % 8).alias("label"), F.col("id").alias("grp"), (F.col("id") % 9 == 0).alias("fixed"), "fold", "vec"), "rows")
    none = spark.createDataFrame([], "i long, rank int, j long, dist double, run int")
    o = optimizer.Options(cycles=6, evolutionary=True, diversity=True, absorption=True, coarsening=True, classifier="pls-lda", components=5)
    found = written(optimizer.optimize(rows, none, o), "found")
    again = linalg.pls_cv(f.select("id", "vec").join(found.where("best").select("id", "label"), "id"), fold, 5)
    return _holds(spark, _core_facts(found, rows, again, 6, True))


@query
def c12_ensemble_invariants(spark, sf_dir):
    f = features(spark, sf_dir)
    groups = f.select("id", F.expr("id div 3").alias("grp"))
    labels, trace, d = ensemble.run_ensemble(f, runs=3, cycles=5, splitting=15, neighbours=20, constrain=groups)
    labels, trace, d = written(labels, "labels"), written(trace, "trace"), written(d, "graph")
    n = f.count()
    again = ensemble.dissimilarity(d.withColumn("dist", F.col("dist") * 0), labels)
    both = again.select("i", "j", F.col("valid").alias("v"), F.col("same").alias("s")).join(d, ["i", "j"])
    per = metrics.classes_by_run(labels).agg(F.min("classes")).first()[0]
    return _holds(spark, {
        "a label for each row and run": labels.count() == 3 * n and labels.select("run", "id").distinct().count() == 3 * n and labels.where("label is null").isEmpty(),
        "agreement is that of the labels": both.count() == d.count() and both.where("v <> valid or s <> same").isEmpty(),
        "constraint groups have one label a run": labels.join(groups, "id").groupBy("run", "grp").agg(F.countDistinct("label").alias("n")).where("n > 1").isEmpty(),
        "no row is its own neighbour": d.where("i = j").isEmpty(),
        "runs have classes": per > 1,
        "runs have traces": trace.groupBy("run").count().where("count <> 5").isEmpty() and trace.select("run").distinct().count() == 3,
    })


@query
def c11_spatial_groups_invariants(spark, sf_dir):
    """Of all three ways: every row has one group, and no group reaches into two samples."""
    p = points(spark, sf_dir)
    n, facts = p.count(), {}
    for mode, name in ((0, "kmeans"), (1, "forest"), (-1, "balanced")):
        g = written(ensemble.spatial_groups(p, 40, 0.2, mode), "groups").join(p.select("id", "sample"), "id")
        facts[f"{name}: a group for each row"] = g.count() == n and g.select("id").distinct().count() == n
        facts[f"{name}: more than one group"] = g.select("grp").distinct().count() > 1
        facts[f"{name}: none across samples"] = g.groupBy("grp").agg(F.countDistinct("sample").alias("s")).where("s > 1").isEmpty()
    return _holds(spark, facts)


@query
def o10_balanced_regions_invariants(spark, sf_dir):
    """Regions are whole parts of the graph: rows of each are joined by edges within it, and it has at least 10 rows unless its component has fewer."""
    f, e = features(spark, sf_dir), _weights(spark, sf_dir)
    found = written(graph.balanced_regions(e, f, 0.1), "regions")
    of = lambda c: found.select(F.col("id").alias(c), F.col("region").alias(f"r_{c}"))
    inside = e.join(of("a"), "a").join(of("b"), "b").where("r_a = r_b").select("a", "b")
    parts = graph.components(inside, f).join(found, "id").groupBy("region").agg(F.countDistinct("component").alias("n"))
    whole = graph.components(e, f).withColumn("all", F.count("*").over(Window.partitionBy("component")))
    small = found.join(whole, "id").groupBy("region").agg(F.count("*").alias("n"), F.max("all").alias("all")).where("n < 10 and all >= 10")
    return _holds(spark, {"a region for each row": found.count() == f.count(), "regions are connected": parts.where("n > 1").isEmpty(), "regions are large enough": small.isEmpty()})


@query
def g3_walktrap_invariants(spark, sf_dir):
    """Clusters don't reach beyond components; without a target they have a higher modularity than single rows, one class and the embeddings' labels; with one they are as many."""
    f, g = features(spark, sf_dir), self_graph(spark, sf_dir)
    e = written(graph.weigh(g, "distance"), "weights")
    found = written(graph.walktrap(e, f), "clusters")
    score = lambda labels: graph.modularity(e, labels).first().modularity
    q = score(found.select("id", F.col("cluster").alias("label")))
    ids = f.select("id")
    apart = found.join(graph.components(e, f), "id").groupBy("cluster").agg(F.countDistinct("component").alias("n"))
    return _holds(spark, {
        "a cluster for each row": found.count() == f.count(),
        "as many as asked for": graph.walktrap(e, f, target=7).select("cluster").distinct().count() == 7,
        "modularity above one class": q > score(ids.withColumn("label", F.lit(1))),
        "modularity above single rows": q > score(ids.withColumn("label", F.col("id"))),
        "modularity at least the labels'": q >= score(f.select("id", "label")),
        "none beyond components": apart.where("n > 1").isEmpty(),
    })


@query
def e4_layout_invariants(spark, sf_dir):
    """Layouts of all rows, finite; neighbours lie nearer together than rows do."""
    f, facts = features(spark, sf_dir), {}
    for name, layout in (("umap", e4_umap(spark, sf_dir)), ("tsne", e6_tsne(spark, sf_dir))):
        y = written(layout.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"]).alias("vec")), "layout")
        of = lambda c: y.select(F.col("id").alias(c), F.col("vec").alias(f"v_{c}"))  # noqa: B023, E731
        gap = lambda e: e.join(of("i"), "i").join(of("j"), "j").agg(F.avg(F.sqrt(F.aggregate(F.zip_with("v_i", "v_j", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))).first()[0]  # noqa: B023, E731
        far = f.select(F.col("id").alias("i"), F.pmod(F.col("id") + 137, F.lit(f.count())).alias("j"))
        facts[f"{name}: a finite place for each row"] = layout.where("v is not null and not isnan(v) and abs(v) < 1e6").count() == 2 * f.count()
        facts[f"{name}: neighbours are near"] = gap(self_graph(spark, sf_dir, 5).select("i", "j")) < gap(far)
    return _holds(spark, facts)


@query
def c3_cv_neighbours(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(votes.cv_neighbours(self_graph(spark, sf_dir, 30), sampling.folds(f, 5), 10), "dist")


@query
def c4_repredict(spark, sf_dir):
    f = features(spark, sf_dir)
    fold = written(sampling.folds(f, 5), "folds")
    near = votes.cv_neighbours(self_graph(spark, sf_dir, 12), fold, 6)
    labels = predictions(spark, sf_dir).select("id", F.col("pred").alias("label"))
    return votes.predict(near, labels, fold)


@query
def c8_absorption_candidates(spark, sf_dir):
    p = predictions(spark, sf_dir).select(F.col("truth").alias("label"), F.when(F.col("truth") < 4, (F.col("truth") + F.col("id") % 5 / 4).cast("int") + 1).otherwise(F.col("pred")).cast("int").alias("pred"))
    return rounded(votes.absorption_candidates(p), "surplus")


@query
def c12_ensemble(spark, sf_dir):
    labels, trace, _ = ensemble.run_ensemble(features(spark, sf_dir), runs=4, cycles=10, splitting=20, neighbours=40)
    best = metrics.best_run(trace).select("run")
    return labels.join(F.broadcast(best), "run").select("run", "id", "label")


@query
def c12_ensemble_graph(spark, sf_dir):
    _, _, d = ensemble.run_ensemble(features(spark, sf_dir), runs=3, cycles=5, splitting=20, neighbours=20, spatial=points(spark, sf_dir))
    return rounded(d.where("same > 0"), "dist")


def _regions(mode):
    def run(spark, sf_dir):
        return ensemble.spatial_groups(points(spark, sf_dir), 40, 0.2, mode)

    return run


for _m in (0, 1, -1):
    QUERIES[f"c11_spatial_groups_{('kmeans', 'forest', 'balanced')[_m]}"] = _regions(_m)


@query
def c14_laplacian_weights(spark, sf_dir):
    return rounded(graph.laplacian_weights(self_graph(spark, sf_dir)), "w")


@query
def c14_laplacian_features(spark, sf_dir):
    return spread(graph.laplacian_features(self_graph(spark, sf_dir), features(spark, sf_dir), 4, 4))


# linear models


def _cv(method):
    def run(spark, sf_dir):
        f = features(spark, sf_dir)
        return linalg.pls_cv(f, written(sampling.folds(f, 5), "folds"), 10, method)

    return run


QUERIES["l1_plsda_cv"] = _cv("pls")
QUERIES["l1_plslda_cv"] = _cv("lda")


def _all_components(method):
    """With as many components as columns, scores span the columns: linear discriminants, and least squares."""

    def run(spark, sf_dir):
        f = features(spark, sf_dir)
        return linalg.pls_predict(f.where("id % 4 > 0"), f.where("id % 4 = 0"), 64, method)

    return run


QUERIES["l3_lda_all_components"] = _all_components("lda")
QUERIES["l4_plsda_all_components"] = _all_components("pls")


@query
def l5_plslda_predict(spark, sf_dir):
    f = features(spark, sf_dir)
    return linalg.pls_predict(f.where("id % 4 > 0"), f.where("id % 4 = 0"))


@query
def l6_pls(spark, sf_dir):
    f = features(spark, sf_dir).select("id", F.slice("vec", 1, 32).alias("vec"), F.slice("vec", 33, 2).alias("y"))
    return spread(linalg.pls(f, 4)[1])


@query
def l7_pca(spark, sf_dir):
    return spread(linalg.pca(features(spark, sf_dir), 5)[0])


@query
def l7_pca_variance(spark, sf_dir):
    m = linalg.pca(features(spark, sf_dir), 64)[1]
    return spark.createDataFrame([(float(m.variances.sum()), float(m.shares.sum()))], "total double, share double").select(r6("total"), r6("share"))


@query
def l8_starting_layout(spark, sf_dir):
    s = linalg.pca(features(spark, sf_dir), 2)[0]
    return spread(linalg.starting_layout(s, "opentsne"))


@query
def l9_screen_features(spark, sf_dir):
    f = features(spark, sf_dir).select("id", (F.col("id") % 2).alias("sample"), F.slice("vec", 1, 2).alias("x"), F.slice("vec", 1, 16).alias("vec"))
    return rounded(spatial.screen_features(f), "p", "score", "q")


# graphs


def _weighed(kind):
    def run(spark, sf_dir):
        return rounded(graph.weigh(self_graph(spark, sf_dir), kind, 0.05), "w")

    return run


for _m in graph.WEIGHTS:
    QUERIES[f"g1_weigh_{_m}"] = _weighed(_m)


@query
def g1_weigh_mutual(spark, sf_dir):
    return rounded(graph.weigh(self_graph(spark, sf_dir), "distance", 0.0, mutual=True), "w")


@query
def g1_weigh_snn_mutual(spark, sf_dir):
    return rounded(graph.weigh(self_graph(spark, sf_dir), "snn", mutual=True), "w")


@query
def g1_weigh_odd_distances(spark, sf_dir):
    """Distances of which some are negative, zero or missing."""
    d = F.when(F.col("j") % 5 == 0, -F.col("dist")).when(F.col("j") % 7 == 0, F.lit(0.0)).when(F.col("j") % 11 == 0, F.lit(None)).otherwise(F.col("dist"))
    return rounded(graph.weigh(self_graph(spark, sf_dir).withColumn("dist", d), "distance"), "w")


@query
def c14_laplacian_weights_zero_scales(spark, sf_dir):
    """Distances of which most of some rows are 0, so that their scale is the row's mean."""
    d = F.when((F.col("i") % 3 == 0) & (F.col("rank") < 10), F.lit(0.0)).otherwise(F.col("dist"))
    return rounded(graph.laplacian_weights(self_graph(spark, sf_dir).withColumn("dist", d)), "w")


@query
def g2_bridged(spark, sf_dir):
    e = written(graph.weigh(self_graph(spark, sf_dir, 3), "distance"), "weights")
    return rounded(graph.bridged(e, features(spark, sf_dir), features(spark, sf_dir)), "w")


@query
def g3_walktrap(spark, sf_dir):
    return graph.cluster_graph(self_graph(spark, sf_dir), features(spark, sf_dir))


@query
def g5_embedding_cluster(spark, sf_dir):
    y = written(linalg.pca(features(spark, sf_dir), 2)[0], "scores")
    return graph.cluster_graph(written(knn.knn_graph(y, 30), "graph"), y, target=10)


@query
def g4_merge_to(spark, sf_dir):
    e = written(graph.weigh(self_graph(spark, sf_dir), "distance"), "weights")
    return graph.merge_to(e, features(spark, sf_dir).select("id", "label"), 4)


# embeddings


@query
def e1_fuzzy_graph(spark, sf_dir):
    return rounded(embed.fuzzy_graph(self_graph(spark, sf_dir)), "w")


@query
def e3_spectral_start(spark, sf_dir):
    e = written(embed.fuzzy_graph(self_graph(spark, sf_dir)), "fuzzy")
    return spread(embed.spectral_start(e, features(spark, sf_dir)))


@query
def e4_umap(spark, sf_dir):
    f = features(spark, sf_dir)
    e = written(embed.fuzzy_graph(self_graph(spark, sf_dir)), "fuzzy")
    return spread(embed.umap_layout(e, linalg.starting_layout(linalg.pca(f, 2)[0], "umap")))


@query
def e5_affinities(spark, sf_dir):
    return rounded(embed.affinities(self_graph(spark, sf_dir, 45)), "w")


@query
def e6_tsne(spark, sf_dir):
    f = features(spark, sf_dir)
    e = written(embed.affinities(self_graph(spark, sf_dir, 45), 15.0), "affinities")
    return spread(embed.tsne_layout(e, linalg.starting_layout(linalg.pca(f, 2)[0], "opentsne"), 15.0, (100, 12.0), 150))


# evaluation


@query
def v1_rand_index(spark, sf_dir):
    return rounded(metrics.rand_index(predictions(spark, sf_dir)), "ari")


@query
def v2_information(spark, sf_dir):
    m = metrics.information(predictions(spark, sf_dir))
    return rounded(m, *m.columns)


@query
def v3_class_scores(spark, sf_dir):
    return rounded(metrics.class_scores(predictions(spark, sf_dir)), "recall", "precision", "dice")


@query
def v3_by_sample(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("sample", (F.col("id") % 3).cast("int"))
    m = metrics.by_sample(p)
    return rounded(m, "ari", "nmi", "homogeneity", "completeness")


@query
def v4_silhouette(spark, sf_dir):
    return rounded(metrics.silhouette(features(spark, sf_dir)), "silhouette")


@query
def v4_silhouette_summary(spark, sf_dir):
    m = metrics.silhouette_summary(features(spark, sf_dir).select("id", (F.col("label") % 4).alias("label"), "vec"))
    return rounded(m, *m.columns)


@query
def v5_scatter(spark, sf_dir):
    m = metrics.scatter(features(spark, sf_dir))
    return rounded(m, *m.columns)


@query
def v6_graph_purity(spark, sf_dir):
    return rounded(metrics.graph_purity(self_graph(spark, sf_dir), features(spark, sf_dir).select("id", "label")), "purity", "mean_row_purity")


@query
def v6_neighbor_purity(spark, sf_dir):
    return rounded(metrics.neighbor_purity(features(spark, sf_dir)), "purity")


@query
def v6_compactness(spark, sf_dir):
    return rounded(metrics.compactness(features(spark, sf_dir)), "rms", "normalized_rms")


@query
def v6_truth_compactness(spark, sf_dir):
    return rounded(metrics.truth_compactness(features(spark, sf_dir)), "compactness")


@query
def v7_conductance(spark, sf_dir):
    return rounded(metrics.conductance(self_graph(spark, sf_dir), features(spark, sf_dir).select("id", "label")), "conductance")


@query
def v7_conductance_summary(spark, sf_dir):
    return rounded(metrics.conductance_summary(self_graph(spark, sf_dir), features(spark, sf_dir).select("id", "label")), "mean", "maximum")


@query
def v7_boundary_f1(spark, sf_dir):
    p = predictions(spark, sf_dir)
    g = self_graph(spark, sf_dir, 3)
    return rounded(metrics.boundary_f1(g, p.select("id", F.col("truth").alias("label")), p.select("id", F.col("pred").alias("label"))), "precision", "recall", "f1")


@query
def v7_agreement_quantiles(spark, sf_dir):
    m = metrics.agreement_quantiles(self_graph(spark, sf_dir), run_labels(spark, sf_dir))
    return rounded(m, *m.columns[1:])


@query
def v8_fit_summary(spark, sf_dir):
    m = metrics.fit_summary(run_labels(spark, sf_dir), traces(spark, sf_dir))
    return rounded(m, *(c for c in m.columns if c not in ("distinct_solutions", "cv_evaluations")))


@query
def v8_cycle_deciles(spark, sf_dir):
    m = metrics.cycle_deciles(traces(spark, sf_dir))
    return rounded(m, *m.columns[2:])


@query
def v8_prefix_agreement(spark, sf_dir):
    return rounded(metrics.prefix_agreement(self_graph(spark, sf_dir), run_labels(spark, sf_dir), (2, 4, 20)), "mean_agreement", "sd_agreement")


@query
def v8_best_run(spark, sf_dir):
    return rounded(metrics.best_run(traces(spark, sf_dir)), "accuracy")


@query
def v8_classes_by_run(spark, sf_dir):
    return metrics.classes_by_run(run_labels(spark, sf_dir))


@query
def v9_align_labels(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return metrics.align_labels(p.select("truth", ((F.col("pred") + 3) % 10).alias("pred")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated KNN of the embeddings' labels."""
    return c1_knn_cv(spark, sf_dir)


__all__ = ["QUERIES", "flagship"]
