"""DuckDB SQL for operators that iterate: recursive or unrolled steps, each kept as a table of its own."""

from __future__ import annotations

from .oracles import VECTORS, EDGES, PRED, F, cells, graph, oracle, r6


def _weights(k: int = 15) -> str:
    """f, and the undirected weights w of its k nearest neighbours."""
    return f"{graph(k)}, w AS MATERIALIZED (SELECT least(i, j) AS a, greatest(i, j) AS b, max(1 / (1 + dist)) AS w FROM e GROUP BY 1, 2)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def times(matrix: str, vector: str) -> str:
    return f"list_transform({matrix}, lambda row_: list_dot_product(row_, {vector}))"


def plus(x: str, factor: str, y: str) -> str:
    """x + factor * y."""
    return f"list_transform(list_zip({x}, {y}), lambda z_: z_[1] + ({factor}) * z_[2])"


def scaled(x: str, factor: str) -> str:
    return f"list_transform({x}, lambda x_: x_ * ({factor}))"


# sampling


def _folds_grouped() -> str:
    return """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_custkey // 7 AS grp, dense_rank() OVER (ORDER BY c_mktsegment) AS label FROM customer),
      n AS (SELECT grp, label, count(*) AS n FROM c GROUP BY 1, 2), g AS (SELECT grp, sum(n) AS size, arg_max(label, n * 100 - label) AS label FROM n GROUP BY 1),
      s AS MATERIALIZED (SELECT grp, CAST(label AS BIGINT) AS label, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY size DESC, md5('1:' || grp)) AS k FROM g),
      r(k, grp, fold, load, own) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), [0::BIGINT, 0, 0, 0, 0], list_transform(range(50), lambda x: 0::BIGINT)
        UNION ALL SELECT k, grp, f - 1, list_transform(range(1, 6), lambda i: load[i] + CASE WHEN i = f THEN size ELSE 0 END), list_transform(range(1, 51), lambda i: own[i] + CASE WHEN i = label * 5 + f THEN size ELSE 0 END)
        FROM (SELECT s.k, s.grp, s.label, s.size, load, own, list_sort(list_transform(range(1, 6), lambda i: {'o': own[s.label * 5 + i], 'l': load[i], 'i': i}))[1].i AS f FROM r JOIN s ON s.k = r.k + 1))
      SELECT id, CAST(fold AS INTEGER) AS fold FROM c JOIN r USING (grp)"""


# graphs


def _spanning(target: int) -> str:
    return f"""WITH RECURSIVE {graph()}, w AS MATERIALIZED (SELECT least(i, j) AS a, greatest(i, j) AS b, max(dist) AS w FROM e GROUP BY 1, 2), n AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM f),
      s AS MATERIALIZED (SELECT x.k AS x, y.k AS y, row_number() OVER (ORDER BY w, a, b) AS k FROM w JOIN n x ON x.id = a JOIN n y ON y.id = b),
      r(k, gone, root) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), (SELECT list(k ORDER BY k) FROM n)
        UNION ALL SELECT s.k, gone + CAST(root[x] <> root[y] AS BIGINT), list_transform(root, lambda q: CASE WHEN q = greatest(root[x], root[y]) THEN least(root[x], root[y]) ELSE q END)
        FROM r JOIN s ON s.k = r.k + 1 WHERE len(root) - gone > {target}),
      t AS (SELECT unnest(root) AS q, unnest(range(1, len(root) + 1)) AS k FROM (SELECT root FROM r ORDER BY k DESC LIMIT 1))
      SELECT id, CAST(dense_rank() OVER (ORDER BY q) AS INTEGER) AS component FROM t JOIN n USING (k)"""


def _bridged() -> str:
    return f"""WITH RECURSIVE {_weights(3)}, both_ AS MATERIALIZED (SELECT a, b FROM w UNION ALL SELECT b, a FROM w), c(id, root) AS (SELECT id, id FROM f UNION SELECT b, root FROM c JOIN both_ ON a = id),
      p AS MATERIALIZED (SELECT id, min(root) AS p FROM c GROUP BY id), l AS (SELECT p, unnest(v) AS x, unnest(range(64)) AS c FROM f JOIN p USING (id)),
      m AS MATERIALIZED (SELECT p, list(m ORDER BY c) AS v FROM (SELECT p, c, avg(x) AS m FROM l GROUP BY 1, 2) GROUP BY p),
      d AS MATERIALIZED (SELECT a.p AS x, b.p AS y, list_distance(a.v, b.v) AS d FROM m a JOIN m b ON a.p < b.p), e2 AS MATERIALIZED (SELECT x, y, d FROM d UNION ALL SELECT y, x, d FROM d),
      way(x, y, d, spot) AS (SELECT x, y, d, x FROM d UNION SELECT way.x, way.y, way.d, e2.y FROM way JOIN e2 ON e2.x = way.spot AND e2.d < way.d),
      tree AS (SELECT x, y FROM way GROUP BY x, y HAVING count(*) FILTER (spot = y) = 0)
      SELECT a, b, {r6('w', 'w')} FROM w UNION ALL SELECT x, y, {r6('(SELECT median(w) FROM w)', 'w')} FROM tree"""


def _merged(classes: int, target: int) -> str:
    steps = [f"""WITH {_weights()}, x AS MATERIALIZED (SELECT w, p.label AS la, q.label AS lb FROM w JOIN f p ON p.id = a JOIN f q ON q.id = b), m0 AS MATERIALIZED (SELECT DISTINCT label, label AS t FROM f)"""]
    for k in range(1, classes - target + 1):
        steps.append(f"""p{k} AS MATERIALIZED (SELECT least(u.t, o.t) AS a, greatest(u.t, o.t) AS b, sum(w) AS w FROM x JOIN m{k - 1} u ON u.label = la JOIN m{k - 1} o ON o.label = lb GROUP BY 1, 2),
      v{k} AS MATERIALIZED (SELECT l, sum(w) AS v FROM (SELECT a AS l, w FROM p{k} UNION ALL SELECT b, w FROM p{k}) GROUP BY l),
      z{k} AS MATERIALIZED (SELECT a, b FROM p{k} JOIN v{k} u ON u.l = a JOIN v{k} o ON o.l = b WHERE a < b ORDER BY w / sqrt(u.v * o.v) DESC, a, b LIMIT 1),
      m{k} AS MATERIALIZED (SELECT label, CASE WHEN t = b THEN a ELSE t END AS t FROM m{k - 1}, z{k})""")
    return ",\n      ".join(steps) + f"\n      SELECT f.id, t AS label FROM f JOIN m{classes - target} USING (label)"


# embeddings: each row's bisection


def _fuzzy() -> str:
    got = "list_sum(list_transform(d, lambda x: CASE WHEN x - rho > 0 THEN exp(-(x - rho) / s) ELSE 1.0 END))"
    return f"""WITH RECURSIVE {graph()}, n AS MATERIALIZED (SELECT i, list(dist ORDER BY rank) AS d, coalesce(min(dist) FILTER (dist > 0), 0.0) AS rho, avg(dist) AS mean FROM e GROUP BY i),
      r(i, k, lo, hi, s, fin) AS (SELECT i, 0, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE, false FROM n
        UNION ALL SELECT i, k + 1, CASE WHEN ok OR got > t THEN lo ELSE s END, CASE WHEN NOT ok AND got > t THEN s ELSE hi END,
          CASE WHEN ok THEN s WHEN got > t THEN (lo + s) / 2 WHEN hi = 'infinity'::DOUBLE THEN s * 2 ELSE (s + hi) / 2 END, ok
        FROM (SELECT r.*, {got} AS got, log2(greatest(2, len(d))) AS t, abs({got} - log2(greatest(2, len(d)))) < 1e-5 AS ok FROM r JOIN n USING (i) WHERE NOT fin AND k < 64)),
      z AS (SELECT i, greatest(arg_max(s, k), 1e-3 * any_value(mean), 1e-12) AS s, any_value(rho) AS rho FROM r JOIN n USING (i) GROUP BY i),
      g AS (SELECT e.i, e.j, CASE WHEN dist - rho > 0 THEN exp(-(dist - rho) / s) ELSE 1.0 END AS w FROM e JOIN z USING (i)),
      x AS (SELECT least(i, j) AS a, greatest(i, j) AS b, coalesce(max(CASE WHEN i < j THEN w END), 0.0) AS p, coalesce(max(CASE WHEN i > j THEN w END), 0.0) AS q FROM g GROUP BY 1, 2)
      SELECT a, b, {r6('p + q - p * q', 'w')} FROM x WHERE p + q - p * q > 1e-6"""


def _affinities(k: int, perplexity: float) -> str:
    s = "list_sum(list_transform(d, lambda x: exp(-beta * x)))"
    h = f"ln({s}) + beta * list_sum(list_transform(d, lambda x: x * exp(-beta * x))) / {s}"
    return f"""WITH RECURSIVE {graph(k)}, n AS MATERIALIZED (SELECT i, list(dist * dist ORDER BY rank) AS q, ln(least({perplexity}, count(*))) AS t FROM e GROUP BY i), m AS MATERIALIZED (SELECT i, t, list_transform(q, lambda x: x - list_min(q)) AS d, list_min(q) AS least_ FROM n),
      r(i, k, lo, hi, beta, fin) AS (SELECT i, 0, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE, false FROM m
        UNION ALL SELECT i, k + 1, CASE WHEN NOT ok AND h > t THEN beta ELSE lo END, CASE WHEN ok OR h > t THEN hi ELSE beta END,
          CASE WHEN ok THEN beta WHEN h <= t THEN (lo + beta) / 2 WHEN hi = 'infinity'::DOUBLE THEN beta * 2 ELSE (beta + hi) / 2 END, ok
        FROM (SELECT r.*, t, {h} AS h, abs({h} - t) < 1e-5 AS ok FROM r JOIN m USING (i) WHERE NOT fin AND k < 200)),
      z AS (SELECT i, arg_max(beta, k) AS beta FROM r GROUP BY i), g AS (SELECT e.i, e.j, exp(-beta * (dist * dist - least_)) AS p FROM e JOIN z USING (i) JOIN m USING (i)),
      y AS (SELECT i, j, p / sum(p) OVER (PARTITION BY i) AS w FROM g), x AS (SELECT least(i, j) AS a, greatest(i, j) AS b, sum(w) AS w FROM y GROUP BY 1, 2)
      SELECT a, b, {r6('w / (SELECT 2 * sum(w) FROM x)', 'w')} FROM x"""


# clusters


def _kmeans(k: int, steps: int) -> str:
    out = [f"""WITH f AS MATERIALIZED ({VECTORS}), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('1:' || id), id) AS k, v FROM f ORDER BY k LIMIT {k})"""]
    for t in range(1, steps + 1):
        out.append(f"""a{t} AS MATERIALIZED (SELECT f.id, min_by(c.k, {{'d': list_sum(list_transform(list_zip(f.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': c.k}}) AS cluster FROM f, c{t - 1} c GROUP BY f.id),
      l{t} AS (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS c FROM f JOIN a{t} USING (id)), c{t} AS MATERIALIZED (SELECT cluster AS k, list(m ORDER BY c) AS v FROM (SELECT cluster, c, avg(x) AS m FROM l{t} GROUP BY 1, 2) GROUP BY cluster)""")
    return ",\n      ".join(out) + f"\n      SELECT id, CAST(cluster AS INTEGER) AS cluster FROM a{steps}"


# linear models: products of columns as lists of lists in one row


def _cov(where: str = "true", dims: int = 64) -> str:
    """mu(n, mean), cov(m): rows of the covariances of f's vectors."""
    return f"""l AS MATERIALIZED (SELECT id, label, unnest(v) AS x, unnest(range(1, {dims + 1})) AS c FROM f WHERE {where}),
      mu AS MATERIALIZED (SELECT list(m ORDER BY c) AS mean, max(n) AS n FROM (SELECT c, avg(x) AS m, count(*) AS n FROM l GROUP BY c)),
      y AS MATERIALIZED (SELECT id, c, x - mean[c] AS x FROM l, mu),
      cov AS MATERIALIZED (SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(s ORDER BY b) AS r FROM (SELECT p.c AS a, q.c AS b, sum(p.x * q.x) / (SELECT n - 1 FROM mu) AS s FROM y p JOIN y q USING (id) GROUP BY 1, 2) GROUP BY a))"""


def _components(k: int, squarings: int = 34) -> str:
    """v1, ..., vk: the leading eigenvectors of cov, by squaring it until one is left, and taking that off."""
    out = []
    for t in range(1, k + 1):
        source = "cov" if t == 1 else f"cov{t}"
        out.append(f"""p{t}(k, m) AS (SELECT 0, m FROM {source} UNION ALL SELECT k + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i]))))
        FROM (SELECT k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS s FROM p{t} WHERE k < {squarings})),
      q{t} AS MATERIALIZED (SELECT m, list_sort(list_transform(range(1, len(m) + 1), lambda i: {{'d': -m[i][i], 'i': i}}))[1].i AS j FROM p{t} WHERE k = {squarings}),
      v{t} AS MATERIALIZED (SELECT {scaled('m[j]', '1 / sqrt(m[j][j])')} AS v FROM q{t}),
      e{t} AS MATERIALIZED (SELECT list_dot_product(v, {times('m', 'v')}) AS e FROM v{t}, {source}),
      cov{t + 1} AS MATERIALIZED (SELECT list_transform(range(1, len(m) + 1), lambda i: {plus('m[i]', '-e * v[i]', 'v')}) AS m FROM {source}, v{t}, e{t})""")
    return ",\n      ".join(out)


def _scores(k: int) -> str:
    centred = "list_transform(list_zip(f.v, mean), lambda z: z[1] - z[2])"
    return f"s AS MATERIALIZED (SELECT id, [{', '.join(dot('x', f'v{t}.v') for t in range(1, k + 1))}] AS v FROM (SELECT id, {centred} AS x FROM f, mu), {', '.join(f'v{t}' for t in range(1, k + 1))})"


_PCA = f"WITH RECURSIVE f AS MATERIALIZED ({VECTORS}), {_cov()}, {{components}}, {{scores}}"


def _pls(components: int) -> str:
    """SIMPLS of two responses (columns 33, 34) on 32 columns: unrolled steps in one row, the 2 x 2 eigenvector in closed form."""
    out = [f"""WITH g AS MATERIALIZED (SELECT id, v[1:34] AS v FROM ({VECTORS})), l AS MATERIALIZED (SELECT id, unnest(v) AS x, unnest(range(1, 35)) AS c FROM g),
      mu AS MATERIALIZED (SELECT list(m ORDER BY c) AS mean, list(sqrt((1 + ss) / (n - 1)) ORDER BY c) AS sd FROM (SELECT c, avg(x) AS m, var_pop(x) * count(*) AS ss, count(*) AS n FROM l GROUP BY c)),
      y AS MATERIALIZED (SELECT id, c, (x - mean[c]) / CASE WHEN c <= 32 THEN sd[c] ELSE 1.0 END AS x FROM l, mu),
      pr AS MATERIALIZED (SELECT p.c AS a, q.c AS b, sum(p.x * q.x) AS s FROM y p JOIN y q USING (id) GROUP BY 1, 2),
      xx AS MATERIALIZED (SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(s ORDER BY b) AS r FROM pr WHERE a <= 32 AND b <= 32 GROUP BY a)),
      t0 AS MATERIALIZED (SELECT list(s ORDER BY a) FILTER (b = 33) AS s1, list(s ORDER BY a) FILTER (b = 34) AS s2 FROM pr WHERE a <= 32 AND b > 32), xy AS MATERIALIZED (SELECT s1 AS y1, s2 AS y2 FROM t0)"""]
    for t in range(1, components + 1):
        a, d, b = dot("s1", "s1"), dot("s2", "s2"), dot("s1", "s2")
        out.append(f"""u{t} AS MATERIALIZED (SELECT s1, s2, a, b, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS top FROM (SELECT t{t - 1}.s1, t{t - 1}.s2, {a.replace('s1', f't{t - 1}.s1')} AS a, {d.replace('s2', f't{t - 1}.s2')} AS d, {b.replace('s1', f't{t - 1}.s1').replace('s2', f't{t - 1}.s2')} AS b FROM t{t - 1})),
      r{t}_0 AS MATERIALIZED (SELECT s1, s2, {plus(scaled('s1', 'b'), 'top - a', 's2')} AS r FROM u{t})""")
        last = f"r{t}_0"
        for n, k in enumerate([*range(1, t)] * 2, 1):  # scores orthogonal to those before, twice
            out.append(f"r{t}_{n} AS MATERIALIZED (SELECT x.s1, x.s2, {plus('x.r', f'-{dot(f't{k}.w', times('m', 'x.r'))}', f't{k}.w')} AS r FROM {last} x, xx, t{k})")
            last = f"r{t}_{n}"
        out.append(f"""n{t} AS MATERIALIZED (SELECT s1, s2, {scaled('r', f'1 / sqrt({dot("r", times("m", "r"))})')} AS w FROM {last}, xx), h{t}_0 AS MATERIALIZED (SELECT n{t}.*, {times('m', f'n{t}.w')} AS v FROM n{t}, xx)""")
        last = f"h{t}_0"
        for n, k in enumerate([*range(1, t)] * 2, 1):
            out.append(f"h{t}_{n} AS MATERIALIZED (SELECT x.s1, x.s2, x.w, {plus('x.v', f'-{dot(f't{k}.v', 'x.v')}', f't{k}.v')} AS v FROM {last} x, t{k})")
            last = f"h{t}_{n}"
        out.append(f"""b{t} AS MATERIALIZED (SELECT s1, s2, w, {scaled('v', f'1 / sqrt({dot("v", "v")})')} AS v FROM {last}),
      t{t} AS MATERIALIZED (SELECT {plus('s1', f'-{dot("v", "s1")}', 'v')} AS s1, {plus('s2', f'-{dot("v", "s2")}', 'v')} AS s2, w, v, {dot('w', 'y1')} AS q1, {dot('w', 'y2')} AS q2 FROM b{t}, xy)""")
    x = "list_transform(range(1, 33), lambda i: (g.v[i] - mean[i]) / sd[i])"
    fit = lambda n: f"mean[{32 + n}] + " + " + ".join(f"t{t}.q{n} * {dot('x', f't{t}.w')}" for t in range(1, components + 1))
    ts = ", ".join(f"t{t}" for t in range(1, components + 1))
    return ",\n      ".join(out) + f",\n      fit AS (SELECT id, [{fit(1)}, {fit(2)}] AS v FROM (SELECT id, {x} AS x, mean FROM g, mu), {ts}) {cells('fit')}"


def _inverse(source: str, dims: int) -> str:
    """inv(m): Gauss and Jordan's elimination of [m, 1], a column a step."""
    return f"""g0 AS MATERIALIZED (SELECT list_transform(range(1, {dims + 1}), lambda i: list_concat(m[i], list_transform(range(1, {dims + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END))) AS m FROM {source}),
      gj(k, m) AS (SELECT 0, m FROM g0 UNION ALL SELECT k + 1, list_transform(range(1, {dims + 1}), lambda i: CASE WHEN i = k + 1 THEN piv ELSE {plus('m[i]', '-m[i][k + 1]', 'piv')} END)
        FROM (SELECT k, m, {scaled('m[k + 1]', '1 / m[k + 1][k + 1]')} AS piv FROM gj WHERE k < {dims})),
      inv AS MATERIALIZED (SELECT list_transform(m, lambda r: r[{dims + 1}:{2 * dims}]) AS m FROM gj WHERE k = {dims})"""


_TRAIN = "f.id % 4 > 0"
_CLASSES = f"""cl AS MATERIALIZED (SELECT label, list(x ORDER BY c) AS v, max(n) AS n FROM (SELECT label, c, avg(x) AS x, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY label)"""


def _lda() -> str:
    return f"""WITH RECURSIVE f AS MATERIALIZED ({VECTORS}), l AS MATERIALIZED (SELECT id, label, unnest(v) AS x, unnest(range(1, 65)) AS c FROM f WHERE {_TRAIN}), {_CLASSES},
      y AS MATERIALIZED (SELECT id, c, x - cl.v[c] AS x FROM l JOIN cl USING (label)), k AS (SELECT sum(n) AS n, count(*) AS k FROM cl),
      cov AS MATERIALIZED (SELECT list(r ORDER BY a) AS m FROM (SELECT a, list(s ORDER BY b) AS r FROM (SELECT p.c AS a, q.c AS b, sum(p.x * q.x) / (SELECT n - k FROM k) AS s FROM y p JOIN y q USING (id) GROUP BY 1, 2) GROUP BY a)),
      {_inverse('cov', 64)}, d AS MATERIALIZED (SELECT label, a, ln(n / (SELECT n FROM k)) - 0.5 * list_dot_product(v, a) AS b FROM (SELECT label, v, n, {times('m', 'v')} AS a FROM cl, inv))
      SELECT f.id, CAST(arg_max(d.label, list_dot_product(f.v, d.a) + d.b) AS BIGINT) AS pred FROM f, d WHERE NOT ({_TRAIN}) GROUP BY f.id"""


def _least_squares() -> str:
    return f"""WITH RECURSIVE f AS MATERIALIZED ({VECTORS}), {_cov(_TRAIN)}, {_CLASSES}, {_inverse('cov', 64)},
      d AS MATERIALIZED (SELECT label, n / nn AS b, {times('m', 's')} AS a, mean FROM (SELECT label, cl.n, mu.n AS nn, mean, {scaled('list_transform(list_zip(cl.v, mean), lambda z: z[1] - z[2])', 'cl.n / (mu.n - 1)')} AS s FROM cl, mu), inv)
      SELECT f.id, CAST(arg_max(d.label, b + list_dot_product(list_transform(list_zip(f.v, mean), lambda z: z[1] - z[2]), a)) AS BIGINT) AS pred FROM f, d WHERE NOT ({_TRAIN}) GROUP BY f.id"""


def _invariants(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS invariant, true AS holds" for n in names)


oracle(
    p11_jitter=f"""WITH {F}, j AS (SELECT id, list_transform(range(1, 3), lambda i: v[i] + CASE WHEN i = 1 THEN 0.5 ELSE 0.25 END * (2 * CAST('0x' || substr(md5('3:' || id || ':' || (i - 1)), 1, 13) AS BIGINT) / 4503599627370496.0 - 1)) AS v FROM f) {cells('j')}""",
    j3_ivf_every_list=f"WITH {graph()} {EDGES} e",
    j3_ivf_recall="SELECT 15 * count(*) AS neighbours, true AS reached FROM embeddings",
    a8_kmeans=_kmeans(10, 10),
    o1_folds_grouped=_folds_grouped(),
    o4_covered_landmarks="""WITH c AS (SELECT c_custkey AS id, c_nationkey AS grp, md5('1:' || c_custkey) AS k FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k, id) AS r FROM c),
      kept AS (SELECT id FROM r WHERE r = 1 AND grp % 5 = 0), missing AS (SELECT id FROM r WHERE r = 1 AND grp % 5 <> 0), spare AS (SELECT id, row_number() OVER (ORDER BY k, id) AS s, count(*) OVER () AS n FROM r WHERE r > 1 AND grp % 5 = 0)
      SELECT id FROM kept UNION ALL SELECT id FROM missing UNION ALL SELECT id FROM spare WHERE s <= n - (SELECT count(*) FROM missing)""",
    o9_spanning_components=_spanning(12),
    l3_lda_all_components=_lda(),
    l4_plsda_all_components=_least_squares(),
    l6_pls=_pls(4),
    l7_pca=_PCA.format(components=_components(5), scores=_scores(5)) + f" {cells('s')}",
    l8_starting_layout=_PCA.format(components=_components(2), scores=_scores(2)) + f", t AS (SELECT 1e-4 / max(sd) AS t FROM (SELECT stddev_pop(x) AS sd FROM (SELECT unnest(v) AS x, unnest([1, 2]) AS c FROM s) GROUP BY c)), y2 AS (SELECT id, list_transform(v, lambda x: x * t) AS v FROM s, t) {cells('y2')}",
    g2_bridged=_bridged(),
    g4_merge_to=_merged(10, 4),
    e1_fuzzy_graph=_fuzzy(),
    e5_affinities=_affinities(45, 30.0),
    v9_align_labels=f"""WITH {F}, {PRED}, n AS (SELECT (pred + 3) % 10 AS pred, truth, count(*) AS n FROM q GROUP BY 1, 2) SELECT CAST(pred AS BIGINT) AS pred, CAST(arg_max(truth, n) AS BIGINT) AS truth, max(n) AS n FROM n GROUP BY pred""",
)

_CORE = ("a trace of all cycles", "accepted as it improves or by temperature", "at least two classes", "fixed rows keep their labels", "groups stay whole",
    "the accuracy is that of the predictions", "the best score never falls", "the predictions are those of the best labels", "the score is the objective")

#: Of results that depend on random streams: what must hold of each, told by the query from its whole result.
oracle(
    c2_core_knn_invariants=_invariants(*_CORE),
    c2_core_pls_lda_invariants=_invariants(*_CORE),
    c12_ensemble_invariants=_invariants("a label for each row and run", "agreement is that of the labels", "constraint groups have one label a run", "no row is its own neighbour", "runs have classes", "runs have traces"),
    c11_spatial_groups_invariants=_invariants(*(f"{n}: {x}" for n in ("kmeans", "forest", "balanced") for x in ("a group for each row", "more than one group", "none across samples"))),
    o10_balanced_regions_invariants=_invariants("a region for each row", "regions are connected", "regions are large enough"),
    g3_walktrap_invariants=_invariants("a cluster for each row", "as many as asked for", "modularity above one class", "modularity above single rows", "modularity at least the labels''", "none beyond components"),
    e4_layout_invariants=_invariants(*(f"{n}: {x}" for n in ("umap", "tsne") for x in ("a finite place for each row", "neighbours are near"))),
    s5_npz=f"WITH {F}, n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, v FROM f ORDER BY f.id LIMIT 100) {cells('n')}",
    s6_spatial_container=f"WITH {F} SELECT id, CAST(id % 2 AS INTEGER) AS sample, label, {r6('v[3]', 'third')}, {r6('v[1]', 'x')}, {r6('v[2]', 'y')} FROM f",
    s8_single_cell_reduction=f"WITH {F} SELECT row_number() OVER (ORDER BY id) - 1 AS id, printf('c%05d', id) AS name, 'slide' || id % 2 AS sample, 8 AS dims, {r6('v[8]', 'last')}, {r6('v[1]', 'x')}, {r6('v[2]', 'y')} FROM f",
    s8_single_cell_counts=f"""WITH c AS (SELECT l_suppkey AS id, 'g' || l_partkey % 6 AS g, sum(CAST(l_quantity AS DOUBLE)) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM c WHERE id % 7 > 0 OR g <> 'g3'),
      every AS (SELECT x.id, y.g FROM (SELECT DISTINCT id FROM k) x, (SELECT DISTINCT g FROM k) y), d AS (SELECT id, list(coalesce(n, 0.0) ORDER BY g) AS v FROM every LEFT JOIN k USING (id, g) GROUP BY id) {cells('d')}""",
)
