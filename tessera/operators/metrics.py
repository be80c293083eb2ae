"""How labels, clusterings, graphs and runs compare. Tables of classes x classes are few rows; rows are only aggregated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vec as V
from tessera.functions.table import beside
from tessera.session import prepare, written

from .knn import block_pairs, knn_graph, stretches
from .stats import assignment


def contingency(rows: DataFrame) -> DataFrame:
    """rows(truth, pred) -> (truth, pred, n, a, b, total): with both margins."""
    n = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    t = n.groupBy("truth").agg(F.sum("n").alias("a"))
    p = n.groupBy("pred").agg(F.sum("n").alias("b"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(t, "truth").join(p, "pred").transform(beside, total)


def rand_index(rows: DataFrame) -> DataFrame:
    """(ari): the adjusted Rand index; 1 where both sides have one class or all rows differ."""
    pairs = lambda c: c * (c - 1) / 2
    n = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    both = n.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    a = n.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    b = n.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    e = F.col("a") * F.col("b") / pairs(F.col("total"))
    top = (F.col("a") + F.col("b")) / 2
    return both.transform(beside, a).transform(beside, b).select(F.when(top == e, 1.0).otherwise((F.col("s") - e) / F.when(top == e, 1.0).otherwise(top - e)).alias("ari"))


def information(rows: DataFrame) -> DataFrame:
    """(mutual, nmi, nmi_sqrt, homogeneity, completeness, v_measure, purity); 1 where an entropy is 0; v_measure 0 where homogeneity and completeness are."""
    c = contingency(rows)
    p, pa, pb = F.col("n") / F.col("total"), F.col("a") / F.col("total"), F.col("b") / F.col("total")
    m = c.agg(F.sum(p * F.log(p / (pa * pb))).alias("mutual"))
    h = lambda key, col: c.select(key, (F.col(col) / F.col("total")).alias("p")).distinct().agg((-F.sum(F.col("p") * F.log("p"))).alias(f"h_{col}"))
    pure = c.groupBy("pred").agg(F.max("n").alias("m"), F.first("total").alias("t")).agg((F.sum("m") / F.max("t")).alias("purity"))
    ratio = lambda x, y: F.when(F.abs(y) < 1e-12, 1.0).otherwise(x / F.when(F.abs(y) < 1e-12, 1.0).otherwise(y))
    both = lambda x, y: F.when(x + y <= 1e-12, 0.0).otherwise(2 * x * y / F.when(x + y <= 1e-12, 1.0).otherwise(x + y))
    s = m.transform(beside, h("truth", "a")).transform(beside, h("pred", "b")).transform(beside, pure)
    i, ha, hb = F.col("mutual"), F.col("h_a"), F.col("h_b")
    hom, com = ratio(i, ha), ratio(i, hb)
    return s.select(
        "mutual", ratio(i, (ha + hb) / 2).alias("nmi"), ratio(i, F.sqrt(F.greatest(ha * hb, F.lit(0.0)))).alias("nmi_sqrt"), hom.alias("homogeneity"), com.alias("completeness"),
        both(hom, com).alias("v_measure"), "purity",
    )


def class_scores(rows: DataFrame) -> DataFrame:
    """(truth, pred, support, recall, precision, dice): each class with the cluster that most of its rows are in, ties to the smaller cluster."""
    w = Window.partitionBy("truth").orderBy(F.desc("n"), "pred")  # clusters a class
    best = contingency(rows).withColumn("r", F.row_number().over(w)).where("r = 1")
    dice = 2 * F.col("n") / (F.col("a") + F.col("b"))
    return best.select("truth", "pred", F.col("a").alias("support"), (F.col("n") / F.col("a")).alias("recall"), (F.col("n") / F.col("b")).alias("precision"), dice.alias("dice"))


def by_sample(rows: DataFrame) -> DataFrame:
    """rows(truth, pred, sample) -> (sample, n, ari, nmi, homogeneity, completeness, clusters) of each sample; nmi over the root of the entropies' product."""
    n = rows.groupBy("sample", "truth", "pred").agg(F.count("*").alias("n"))
    total = n.groupBy("sample").agg(F.sum("n").alias("total"), F.countDistinct("pred").alias("clusters"))
    t, p = (n.groupBy("sample", k).agg(F.sum("n").alias(c)) for k, c in (("truth", "a"), ("pred", "b")))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    info = n.join(t, ["sample", "truth"]).join(p, ["sample", "pred"]).join(total, "sample")
    info = info.groupBy("sample").agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("i"), F.sum(pairs("n")).alias("s"))
    side = lambda df, c: df.join(total, "sample").groupBy("sample").agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h{c}"), F.sum(pairs(c)).alias(f"p{c}"))
    x = total.join(info, "sample").join(side(t, "a"), "sample").join(side(p, "b"), "sample")
    every = pairs("total")
    expected = F.when(every > 0, F.col("pa") * F.col("pb") / F.when(every > 0, every).otherwise(1.0)).otherwise(0.0)
    low = (F.col("pa") + F.col("pb")) / 2 - expected
    some = lambda c: F.col(c) > 1e-12
    part = lambda c: F.when(some(c), F.col("i") / F.when(some(c), F.col(c)).otherwise(1.0)).otherwise(1.0)
    nmi = F.when(some("ha") & some("hb"), F.col("i") / F.sqrt(F.when(some("ha") & some("hb"), F.col("ha") * F.col("hb")).otherwise(1.0))).otherwise(1.0)
    ari = F.when(low == 0, 1.0).otherwise((F.col("s") - expected) / F.when(low == 0, 1.0).otherwise(low))
    return x.select("sample", F.col("total").alias("n"), ari.alias("ari"), nmi.alias("nmi"), part("ha").alias("homogeneity"), part("hb").alias("completeness"), "clusters")


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("id", "label", F.posexplode(V.doubles(F.col("vec"))).alias("c", "v"))


def centroids(rows: DataFrame) -> DataFrame:
    """(label, n, vec)."""
    m = _long(rows).groupBy("label", "c").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    return m.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"]).alias("vec"))


def finite(rows: DataFrame) -> DataFrame:
    """(id, label, vec) of the rows that have a label and only finite numbers."""
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("id", "label", V.doubles(F.col("vec")).alias("vec")).where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(ok, F.lit(False)))


def sampled(rows: DataFrame, most: int | None, seed: int = 4) -> DataFrame:
    """All rows, or the `most` of them whose ids hash lowest."""
    rows = written(rows, "rows")
    if most is None or rows.count() <= most:
        return rows
    return written(rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(most), "sample")


#: Rows of both sides whose products are held at once.
HELD = 256, 4_096


def _squares(q: pd.DataFrame, b: pd.DataFrame):
    """Both sides by label, and their squared distances piece by piece: (q's rows, b's rows, products); a row and itself (an equal id) as `same` of a piece."""
    q, b = (d.sort_values("label", kind="stable") for d in (q, b))
    x, y = (np.concatenate([np.asarray(v, float) for v in d["vec"]]).reshape(len(d), -1) for d in (q, b))
    middle = (y / len(y)).sum(axis=0)
    x, y = x - middle, y - middle  # near zero, differences of squares lose less
    left = np.concatenate([-2 * x, np.ones((len(x), 1)), np.square(x).sum(axis=1)[:, None]], axis=1)
    right = np.concatenate([y, np.square(y).sum(axis=1)[:, None], np.ones((len(y), 1))], axis=1)
    ids, by = b["id"].to_numpy(), np.argsort(b["id"].to_numpy(), kind="stable")

    def pieces():
        for u in range(0, len(q), HELD[0]):
            rows = slice(u, min(u + HELD[0], len(q)))
            own = q["id"].to_numpy()[rows]
            lo, hi = (np.searchsorted(ids, own, side, sorter=by) for side in ("left", "right"))
            which, at = stretches(lo, hi - lo)
            at = by[at]
            for v in range(0, len(b), HELD[1]):
                cols = slice(v, min(v + HELD[1], len(b)))
                here = (at >= cols.start) & (at < cols.stop)
                yield rows, cols, np.maximum(left[rows] @ right[cols].T, 0.0), (which[here], at[here] - v)

    return q, b, x, y, pieces()


def _class_sums(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(id, label, k, s, n): the summed distances of each row of q to the rows of b of each label k, itself left out."""
    if not len(q) or not len(b):
        return pd.DataFrame({"id": [], "label": [], "k": [], "s": [], "n": []})
    q, b, _, _, pieces = _squares(q, b)
    classes, own = np.unique(b["label"].to_numpy(), return_inverse=True)
    s = np.zeros((len(q), len(classes)))
    n = np.repeat(np.bincount(own, minlength=len(classes))[None], len(q), axis=0)
    for rows, cols, d, same in pieces:
        d[same] = 0.0
        np.sqrt(d, out=d)
        starts = np.flatnonzero(np.diff(own[cols], prepend=-1))
        s[rows, own[cols][starts]] += np.add.reduceat(d, starts, axis=1)
        np.subtract.at(n, (same[0] + rows.start, own[same[1] + cols.start]), 1)
    return pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), len(classes)), "label": np.repeat(q["label"].to_numpy(), len(classes)), "k": np.tile(classes, len(q)), "s": s.ravel(), "n": n.ravel()})


def silhouette(rows: DataFrame, most: int | None = None, seed: int = 4) -> DataFrame:
    """rows(id, label, vec) -> (label, n, silhouette), and the mean over all rows (label null): (b - a) / max(a, b) from mean Euclidean distances.

    a: to the other rows of the class, b: the least mean to another class. A class of one row scores 0; with
    one class there is none (null). Rows without a label or a finite vector take no part. The distances of
    all pairs are needed: all rows meet in pairs of blocks. A caller may ask for a sample of `most` rows, by their ids' hashes.
    """
    prepare(rows.sparkSession)
    own = sampled(finite(rows), most, seed)
    kind = dict(own.dtypes)
    met = block_pairs(own, own, _class_sums, f"id {kind['id']}, label {kind['label']}, k {kind['label']}, s double, n long")
    sums = met.groupBy("id", "label", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    mean, same = F.col("s") / F.col("n"), F.col("label") == F.col("k")
    r = sums.groupBy("id", "label").agg(F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return r.withColumn("s", s).rollup("label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))


def silhouette_summary(rows: DataFrame, most: int | None = None, seed: int = 4) -> DataFrame:
    """(silhouette, silhouette_class_min): the mean over all rows, and the least class's."""
    by = silhouette(rows, most, seed)
    return by.agg(F.max(F.when(F.col("label").isNull(), F.col("silhouette"))).alias("silhouette"), F.min(F.when(F.col("label").isNotNull(), F.col("silhouette"))).alias("silhouette_class_min"))


def _extremes(key: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(intra, inter): the largest distance of two rows of a class, the least of two rows of different classes."""
    intra, inter = -np.inf, np.inf
    if len(q) and len(b):
        q, b, x, y, pieces = _squares(q, b)
        lx, ly = q["label"].to_numpy(), b["label"].to_numpy()
        slack = 2.0**-44 * (np.square(x).sum(axis=1).max() + np.square(y).sum(axis=1).max())  # of a product; the least distances are computed anew
        for rows, cols, d, same in pieces:
            alike = []
            for label in np.unique(lx[rows]):
                u, v = (slice(*(np.searchsorted(z, label, side) for side in ("left", "right"))) for z in (lx[rows], ly[cols]))
                if v.start < v.stop:
                    alike.append((u, v))
            d[same] = -np.inf
            for u, v in alike:
                intra = max(intra, d[u, v].max())
                d[u, v] = np.inf
            d[same] = np.inf
            least = d.min()
            if np.isfinite(least) and least <= inter + slack:
                r, c = np.nonzero(d <= least + slack)
                inter = min(inter, *(np.square(x[rows][r[a : a + 4096]] - y[cols][c[a : a + 4096]]).sum(axis=1).min() for a in range(0, len(r), 4096)), np.inf)
    return pd.DataFrame({"intra": [np.sqrt(intra) if intra >= 0 else intra], "inter": [np.sqrt(inter)]})


def scatter(rows: DataFrame, most: int | None = None, seed: int = 4) -> DataFrame:
    """rows(id, label, vec) -> (within, between, calinski_harabasz, davies_bouldin, separation_ratio, dunn).

    davies_bouldin from the root mean squared distances to the centroids; dunn: the least distance of two rows of different classes over
    the largest of two of one, of all rows (or, if a caller asks, of a sample of `most`). With fewer than two classes, or as many as
    rows, all are null.
    """
    prepare(rows.sparkSession)
    rows = written(finite(rows), "rows")
    c = written(centroids(rows), "centroids")
    x = rows.join(F.broadcast(c.select("label", F.col("vec").alias("m"))), "label")  # one row a class
    by = x.groupBy("label").agg(F.sum(V.squared_distance(F.col("vec"), F.col("m"))).alias("w"), F.count("*").alias("n"))
    by = written(by.withColumn("s", F.sqrt(F.col("w") / F.col("n"))), "classes")
    mean = rows.select(F.posexplode("vec").alias("c", "v")).groupBy("c").agg(F.avg("v").alias("v"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"]).alias("g"))
    between = c.transform(beside, mean).agg(F.sum(F.col("n") * V.squared_distance(F.col("vec"), F.col("g"))).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k"))
    t = c.select("label", "vec").join(by.select("label", "s"), "label")
    o = t.select(F.col("label").alias("o"), F.col("vec").alias("ov"), F.col("s").alias("os"))
    gap = t.transform(beside, o).where(F.col("label") != F.col("o")).withColumn("d", F.sqrt(V.squared_distance(F.col("vec"), F.col("ov"))))  # classes x classes
    worst = gap.groupBy("label").agg(F.max((F.col("s") + F.col("os")) / F.greatest("d", F.lit(np.finfo(float).eps))).alias("r"))
    bouldin = worst.agg(F.avg("r").alias("davies_bouldin"))
    own = sampled(rows, most, seed)
    ends = block_pairs(own, own, _extremes, "intra double, inter double").agg(F.max("intra").alias("intra"), F.min("inter").alias("inter"))
    s = by.agg(F.sum("w").alias("within")).transform(beside, between).transform(beside, bouldin).transform(beside, ends)
    ok = (F.col("k") >= 2) & (F.col("k") < F.col("n"))
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b).otherwise(1.0))
    ch = over(F.col("between") / F.when(ok, F.col("k") - 1).otherwise(1), F.col("within") / F.when(ok, F.col("n") - F.col("k")).otherwise(1))
    dunn = F.when((F.col("intra") >= 0) & (F.col("inter") < float("inf")), over(F.col("inter"), F.col("intra")))
    separation = F.col("between") / F.greatest("within", F.lit(np.finfo(float).eps))
    found = {"within": F.col("within"), "between": F.col("between"), "calinski_harabasz": ch, "davies_bouldin": F.col("davies_bouldin"), "separation_ratio": separation, "dunn": dunn}
    return s.select(*(F.when(ok, v).alias(k) for k, v in found.items()))


def edge_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    return edges.join(of("i"), "i").join(of("j"), "j")


def graph_purity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(edges, purity, mean_row_purity): share of edges within a class, over all edges and as the mean over rows."""
    same = (F.col("l_i") == F.col("l_j")).cast("double")
    by = edge_labels(edges, labels).groupBy("i").agg(F.count("*").alias("n"), F.sum(same).alias("s"))
    return by.agg(F.sum("n").alias("edges"), (F.sum("s") / F.sum("n")).alias("purity"), F.avg(F.col("s") / F.col("n")).alias("mean_row_purity"))


def neighbor_purity(rows: DataFrame, k: int = 15, most: int | None = None, seed: int = 17) -> DataFrame:
    """rows(id, label, vec) -> (n, purity): the mean share of a row's k nearest others that have its label, of all rows (or, if a caller asks, of a sample of `most`); null for fewer than k + 2 rows."""
    own = sampled(finite(rows), most, seed)
    n = own.count()
    if n < k + 2:
        return own.sparkSession.createDataFrame([(n, None)], "n long, purity double")
    near = graph_purity(knn_graph(own, k), own.select("id", "label"))
    return near.select(F.lit(n).cast("long").alias("n"), F.col("mean_row_purity").alias("purity"))


def compactness(rows: DataFrame) -> DataFrame:
    """(label, n, rms, normalized_rms): the root mean squared distance of a class's rows to its centroid, and that over the same of all rows to theirs (null where that is 0)."""
    rows = written(finite(rows), "rows")
    c = centroids(rows).select("label", F.col("vec").alias("m"))
    mean = rows.select(F.posexplode("vec").alias("c", "v")).groupBy("c").agg(F.avg("v").alias("v"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: p["v"]).alias("g"))
    x = rows.join(F.broadcast(c), "label").transform(beside, mean)  # one row a class
    rms = lambda to: F.sqrt(F.avg(V.squared_distance(F.col("vec"), F.col(to))))
    overall = rows.transform(beside, mean).agg(rms("g").alias("overall"))
    by = x.groupBy("label").agg(F.count("*").alias("n"), rms("m").alias("rms"))
    return by.transform(beside, overall).select("label", "n", "rms", F.when(F.col("overall") > 0, F.col("rms") / F.when(F.col("overall") > 0, F.col("overall")).otherwise(1.0)).alias("normalized_rms"))


def truth_compactness(rows: DataFrame) -> DataFrame:
    """(compactness): the median of the classes' normalized_rms."""
    return compactness(rows).agg(F.median("normalized_rms").alias("compactness"))


def conductance(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """graph(i, j, dist), labels(id, label) -> (label, conductance): the weight of a class's edges that leave it over the smaller of its
    edges' weight and the others', 0 where that is 0. An edge weighs 1 / (1 + dist) on the side of i; self-loops and edges without a finite distance don't count."""
    w = 1 / (1 + F.greatest("dist", F.lit(0.0)))
    kept = graph.where("i <> j and dist is not null and not isnan(dist) and abs(dist) < double('infinity')").select("i", "j", w.alias("w"))
    v = edge_labels(kept, labels).groupBy(F.col("l_i").alias("label")).agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("l_i") != F.col("l_j"), F.col("w")).otherwise(0.0)).alias("cut"))
    v = labels.select("label").where("label is not null").distinct().join(v, "label", "left").fillna(0.0, ["vol", "cut"])
    total = v.agg(F.sum("vol").alias("all"))
    low = F.least("vol", F.col("all") - F.col("vol"))
    return v.transform(beside, total).select("label", F.when(low > 1e-12, F.col("cut") / F.when(low > 1e-12, low).otherwise(1.0)).otherwise(0.0).alias("conductance"))


def conductance_summary(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(mean, maximum) over the classes."""
    return conductance(graph, labels).agg(F.avg("conductance").alias("mean"), F.max("conductance").alias("maximum"))


def boundary_f1(edges: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(precision, recall, f1) of the edges that join rows of different classes, predicted against true."""
    of = lambda c: truth.select(F.col("id").alias(c), F.col("label").alias(f"t_{c}")).join(pred.select(F.col("id").alias(c), F.col("label").alias(f"p_{c}")), c)
    both = edges.where("i <> j").join(of("i"), "i").join(of("j"), "j")
    t, p = ((F.col(f"{x}_i") != F.col(f"{x}_j")).cast("int") for x in "tp")
    s = both.agg(F.sum(t * p).alias("hit"), F.sum(t).alias("t"), F.sum(p).alias("p")).fillna(0)
    part = lambda a: F.col("hit") / F.greatest(F.col(a), F.lit(1))
    s = s.select(part("p").alias("precision"), part("t").alias("recall"))
    sum_ = F.col("precision") + F.col("recall")
    return s.select("precision", "recall", F.when(sum_ > 0, 2 * F.col("precision") * F.col("recall") / F.when(sum_ > 0, sum_).otherwise(1.0)).otherwise(0.0).alias("f1"))


def _edge_agreement(graph: DataFrame, labels: DataFrame, prefixes: list[int], most: int | None, seed: int) -> DataFrame:
    """(i, j, a0, a1, ...): the share of the first runs of each prefix in which both ends have one label; of all edges, or of a sample of `most` by a hash.

    Labels are gathered once a node, by run, so an edge brings two arrays together.
    """
    e = graph.where("i <> j").select("i", "j")
    if most is not None and e.count() > most:
        e = written(e.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string"))), "i", "j").limit(most), "edges")
    packed = labels.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "label"))), lambda x: x["label"]).alias("m"))  # one number a run
    of = lambda c: packed.select(F.col("id").alias(c), F.col("m").alias(f"m_{c}"))
    met = e.join(of("i"), "i").join(of("j"), "j").withColumn("same", F.zip_with("m_i", "m_j", lambda x, y: F.when(x == y, 1.0).otherwise(0.0)))
    return met.select("i", "j", *((V.total(F.slice("same", 1, m)) / m).alias(f"a{n}") for n, m in enumerate(prefixes)))


def agreement_quantiles(graph: DataFrame, labels: DataFrame, at: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0), most: int | None = None, seed: int = 812) -> DataFrame:
    """graph(i, j), labels(run, id, label) -> (edges, q0, q10, ...): quantiles, interpolated, of the edges' share of runs in which both ends have one label."""
    runs = labels.select("run").distinct().count()
    e = _edge_agreement(graph, labels, [runs], most, seed)
    return e.agg(F.count("*").alias("edges"), *(F.percentile("a0", F.lit(q)).alias(f"q{round(100 * q)}") for q in at))


def prefix_agreement(graph: DataFrame, labels: DataFrame, prefixes: tuple[int, ...] = (10, 20, 50, 100), most: int | None = None, seed: int = 9095) -> DataFrame:
    """graph(i, j), labels(run, id, label) -> (prefix, edges, mean_agreement, sd_agreement): the edges' agreement over the first runs; prefixes beyond the runs are all runs."""
    runs = labels.select("run").distinct().count()
    use = sorted({min(p, runs) for p in prefixes})
    e = written(_edge_agreement(graph, labels, use, most, seed), "agreement")
    out = None
    for n, m in enumerate(use):
        one = e.agg(F.lit(m).alias("prefix"), F.count("*").alias("edges"), F.avg(f"a{n}").alias("mean_agreement"), F.stddev_samp(f"a{n}").alias("sd_agreement"))
        out = one if out is None else out.union(one)
    return out


def fit_summary(labels: DataFrame, trace: DataFrame) -> DataFrame:
    """labels(run, id, label), trace(CYCLE) -> one row: the runs' last accuracies (cv_), their numbers of classes, the shares of runs of one and of at most two classes,
    how many solutions differ, the shares of accepted cycles, the mean size of a proposal, and the evaluations."""
    last = trace.groupBy("run").agg(F.max_by("accuracy", "cycle").alias("a"))
    q = lambda c, x: F.percentile(c, F.lit(x))
    acc = last.agg(F.avg("a").alias("cv_mean"), q("a", 0.5).alias("cv_median"), F.stddev_samp("a").alias("cv_sd"), F.min("a").alias("cv_min"), F.max("a").alias("cv_max"), F.count("*").alias("runs"))
    # a run's labels as two sums that don't depend on the order of rows
    mark = [F.sum(F.xxhash64(F.lit(k), "id", "label").cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]
    by = labels.groupBy("run").agg(F.countDistinct("label").alias("c"), *mark)
    share = lambda cond: F.avg(cond.cast("double"))
    cls = by.agg(
        F.avg("c").alias("classes_mean"), q("c", 0.5).alias("classes_median"), (q("c", 0.75) - q("c", 0.25)).alias("classes_iqr"),
        share(F.col("c") <= 1).alias("collapse_one_rate"), share(F.col("c") <= 2).alias("collapse_two_rate"), F.countDistinct("h0", "h1").alias("distinct_solutions"),
    )
    cyc = trace.agg(
        share(F.col("accepted")).alias("acceptance_rate"), share(F.col("improving")).alias("improving_acceptance_rate"), share(F.col("temperature")).alias("temperature_acceptance_rate"),
        F.avg("proposal_size").alias("proposal_size_mean"), F.count("*").alias("cycles"),
    )
    out = acc.transform(beside, cls).transform(beside, cyc).withColumn("cv_evaluations", F.col("runs") + F.col("cycles"))
    return out.drop("runs", "cycles")


def cycle_deciles(trace: DataFrame) -> DataFrame:
    """trace(CYCLE) -> (decile, cycles, proposal_size, active_classes, acceptance_rate, improving_rate, temperature_rate): means of each tenth of the cycles."""
    last = trace.agg(F.max("cycle").alias("last"))
    tenth = F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(10 * F.col("cycle") / F.col("last")))).cast("int")
    share = lambda c, name: F.avg(F.col(c).cast("double")).alias(name)
    return trace.transform(beside, last).groupBy(tenth.alias("decile")).agg(
        F.count("*").alias("cycles"), F.avg("proposal_size").alias("proposal_size"), F.avg("active_classes").alias("active_classes"),
        share("accepted", "acceptance_rate"), share("improving", "improving_rate"), share("temperature", "temperature_rate"),
    )


def best_run(trace: DataFrame) -> DataFrame:
    """(run, accuracy): the run of the best last accuracy, ties to the first."""
    last = trace.groupBy("run").agg(F.max_by("accuracy", "cycle").alias("accuracy"))
    return last.agg(F.max(F.struct("accuracy", (-F.col("run")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("run"), F.col("b.accuracy").alias("accuracy"))


def classes_by_run(labels: DataFrame) -> DataFrame:
    return labels.groupBy("run").agg(F.countDistinct("label").alias("classes"))


def align_labels(rows: DataFrame) -> DataFrame:
    """rows(truth, pred) -> (pred, truth, n): classes paired one to one so that most rows agree. Classes are few and meet on the driver; those left over pair with null."""
    n = rows.groupBy("truth", "pred").agg(F.count("*").alias("n")).collect()
    t, p = sorted({r.truth for r in n}), sorted({r.pred for r in n})
    table = np.zeros((max(len(p), 1), max(len(t), len(p), 1)))
    for r in n:
        table[p.index(r.pred), t.index(r.truth)] = r.n
    out = [(int(c), int(t[k]) if k < len(t) else None, int(table[i, k])) for i, (c, k) in enumerate(zip(p, assignment(-table), strict=True))] if p else []
    return rows.sparkSession.createDataFrame(out, "pred long, truth long, n long")
