"""DuckDB SQL for the queries, in the same order as queries.py. Sums over dimensions run in order, as the operators' do."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

VECTORS = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings"
F = f"f AS ({VECTORS})"
P = "p AS (SELECT id, CAST(id % 2 AS INTEGER) AS sample, v[1:2] AS v FROM f)"
S = "s AS (SELECT l_suppkey AS id, [round(CAST(sum(l_quantity) AS DOUBLE), 3), round(CAST(avg(l_extendedprice) AS DOUBLE), 3), round(CAST(avg(l_discount) AS DOUBLE), 3), round(CAST(avg(l_tax) AS DOUBLE), 3), CAST(count(*) AS DOUBLE)] AS v FROM lineitem GROUP BY 1)"
PRED = "q AS (SELECT id, label AS truth, CASE WHEN CAST('0x' || substr(md5('p:' || id), 1, 4) AS INTEGER) % 4 = 0 THEN (label + 1) % 10 ELSE label END AS pred FROM f)"
RUNS = "r AS (SELECT run, id, CASE WHEN CAST('0x' || substr(md5(run || ':' || id), 1, 4) AS INTEGER) % 5 = 0 THEN (label + run) % 10 ELSE label END AS label FROM f, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS run))"
TRACE = "t AS (SELECT run, CAST(row_number() OVER w AS INTEGER) AS cycle, max(round((c_acctbal + 1000) / 12000, 9)) OVER (PARTITION BY run ORDER BY key ROWS UNBOUNDED PRECEDING) AS accuracy, key * 7 % 23 + 1 AS size, key % 5 + 2 AS active, CAST(key % 3 = 0 AS DOUBLE) AS up, CAST(key % 7 = 0 AND key % 3 > 0 AS DOUBLE) AS warm FROM (SELECT c_nationkey + 1 AS run, c_custkey AS key, c_acctbal FROM customer) WINDOW w AS (PARTITION BY run ORDER BY key))"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def cells(table: str, *keep: str) -> str:
    """Rows of (id, keep, c, v) from (id, keep, v list)."""
    k = "".join(f"{x}, " for x in keep)
    return f"SELECT id, {k}CAST(c AS INTEGER) AS c, {r6('x', 'v')} FROM (SELECT id, {k}unnest(v) AS x, unnest(range(len(v))) AS c FROM {table})"


def total(e: str) -> str:
    return f"list_sum(list_transform({e}))"


EUCLID = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))"


def knn(name: str, k: int, query: str, base: str, dist: str = EUCLID, on: str = "a.id <> b.id") -> str:
    return (
        f"{name}_d AS (SELECT a.id AS i, b.id AS j, {dist} AS dist FROM {query} a JOIN {base} b ON {on}), "
        f"{name} AS (SELECT i, CAST(rank AS INTEGER) AS rank, j, dist FROM (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM {name}_d) WHERE rank <= {k})"
    )


def graph(k: int = 15) -> str:
    return f"{F}, {knn('e', k, 'f', 'f')}"


EDGES = f"SELECT i, rank, j, {r6('dist', 'dist')} FROM"
UNIT = "u AS (SELECT id, label, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS v FROM (SELECT id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM f))"
FOLDS = lambda n: f"fo AS (SELECT id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('1:' || id), id) - 1) % {n} AS INTEGER) AS fold FROM f)"


def oracle(**sql: str) -> None:
    ORACLES.update(sql)


oracle(
    s1_scan_matrix=f"WITH {F} SELECT id, len(v) AS cols, {r6('v[1]', 'first')}, {r6('v[64]', 'last')} FROM f",
    s2_gather_rows=f"WITH {F} SELECT id, label FROM f WHERE id IN (SELECT o_custkey FROM orders)",
    s3_raw_roundtrip=f"WITH {F} {cells('f')}",
    s7_import_sparse=f"""WITH x AS (SELECT l_suppkey AS i, l_partkey AS j, 1.0 - least(greatest(CAST(l_discount AS DOUBLE), 0.0), 1.0) AS dist, l_orderkey * 10 + l_linenumber AS pos FROM lineitem WHERE l_suppkey <> l_partkey)
      SELECT i, CAST(rank AS INTEGER) AS rank, j, {r6('dist', 'dist')} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, pos, j) AS rank FROM x) WHERE rank <= 10""",
    s8_transpose=f"WITH {F}, l AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS c FROM f) SELECT CAST(c AS BIGINT) AS id, count(*) AS rows, {r6('arg_min(x, id)', 'first')} FROM l GROUP BY c",
    s9_first_dims=f"WITH {F}, h AS (SELECT id, v[1:8] AS v FROM f) {cells('h')}",
    s10_top_features="SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50",
    s11_manifolds=f"""WITH g AS (SELECT id, id / 299.0 AS t, ((id * 7919) % 300) / 300.0 AS s, pi() AS pi FROM (SELECT unnest(range(300)) AS id)),
      m AS (SELECT 'dini' AS kind, id, [cos(4 * pi * t) * sin(0.01 + 0.98 * s), sin(4 * pi * t) * sin(0.01 + 0.98 * s), cos(0.01 + 0.98 * s) + ln(tan((0.01 + 0.98 * s) / 2)) + 0.2 * (4 * pi * t)] AS v FROM g
      UNION ALL SELECT 'helicoid', id, [(2 * s - 1) * cos(4 * pi * t - 2 * pi), (2 * s - 1) * sin(4 * pi * t - 2 * pi), 4 * pi * t - 2 * pi] FROM g
      UNION ALL SELECT 'swiss_roll', id, [1.5 * pi * (1 + 2 * t) * cos(1.5 * pi * (1 + 2 * t)), 21.0 * s, 1.5 * pi * (1 + 2 * t) * sin(1.5 * pi * (1 + 2 * t))] FROM g
      UNION ALL SELECT 'spirals', id, [(0.1 + 0.9 * t) * cos(4 * pi * t + 2 * pi * (id % 3) / 3), (0.1 + 0.9 * t) * sin(4 * pi * t + 2 * pi * (id % 3) / 3)] FROM g)
      {cells('m', 'kind')}""",
    p1_validate="SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS cols FROM embeddings",
    p2_encode_labels="SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS code FROM part",
    p3_l2_normalize=f"WITH {F}, {UNIT} {cells('u')}",
)

_PART = "CASE WHEN id % 2 = 0 THEN 'train' ELSE 'test' END"
_ABS = "list_sum(list_transform(v, lambda x: abs(x)))"


def _norm(coef: str) -> str:
    return f"""WITH {S}, k AS (SELECT id, {_PART} AS part, v, {coef} AS coef FROM s)
      SELECT id, part, {r6('coef', 'coef')}, CAST(c AS INTEGER) AS c, {r6('x / coef', 'v')} FROM (SELECT id, part, coef, unnest(v) AS x, unnest(range(5)) AS c FROM k)"""


oracle(
    p4_normalize_pqn=f"""WITH {S}, k AS (SELECT id, {_PART} AS part, v, {_ABS} AS s FROM s), l AS (SELECT id, part, s, unnest(v) / s AS x, unnest(range(5)) AS c FROM k),
      m AS (SELECT c, median(x) AS m FROM l WHERE part = 'train' GROUP BY c), z AS (SELECT id, median(x / m) AS q FROM l JOIN m USING (c) GROUP BY id)
      SELECT id, part, {r6('q * s', 'coef')}, CAST(c AS INTEGER) AS c, {r6('x / q', 'v')} FROM l JOIN z USING (id)""",
    p5_normalize_sum=_norm(f"CASE WHEN id % 2 = 0 THEN list_sum(v) ELSE {_ABS} END"),
    p5_normalize_median=_norm("list_median(v)"),
    p5_normalize_sqrt=_norm("sqrt(list_sum(list_transform(v, lambda x: x * x)))"),
)
for _name, _scale in (("centering", "1.0"), ("autoscaling", "stddev_samp(x)"), ("rangescaling", "max(x) - min(x)"), ("paretoscaling", "sqrt(stddev_samp(x))")):
    ORACLES[f"p6_scale_{_name}"] = f"""WITH {S}, l AS (SELECT id, CASE WHEN id % 3 > 0 THEN 'train' ELSE 'test' END AS part, unnest(v) AS x, unnest(range(5)) AS c FROM s),
      m AS (SELECT c, avg(x) AS m, {_scale} AS w FROM l WHERE part = 'train' GROUP BY c) SELECT id, part, CAST(c AS INTEGER) AS c, {r6('(x - m) / w', 'v')} FROM l JOIN m USING (c)"""

def _objective(rows: str) -> str:
    """The score by its definition: chance that two rows differ, entropies of the classes, accuracy."""
    keep = lambda x, name: f"CASE WHEN k > 1 THEN round({x}, 6) + 0.0 END AS {name}"
    return f"""c AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = pred) AS r FROM {rows} GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k, sum(r) AS hits FROM c),
      s AS (SELECT max(k) AS k, max(t) AS n, max(hits / t) AS acc, 1 - sum((n / t) * (n / t)) AS d, -sum((n / t) * ln(n / t)) AS h FROM c, t),
      z AS (SELECT *, CASE WHEN k = 1 THEN 0.0 ELSE greatest(least(1.0, greatest(0.0, h / ln(n))), greatest(0.0, ln(k / exp(h))) / (1 + greatest(0.0, ln(k / exp(h))))) END AS cost FROM s)
      SELECT k AS classes, {r6('acc', 'accuracy')}, {r6('d', 'diversity')}, {r6('cost', 'cost')}, {keep('acc * sqrt(greatest(d, 0.0))', 'guarded')}, {r6('acc - (1 - acc) * cost', 'fragmented')}, {keep('acc * sqrt(greatest(d, 0.0)) - (1 - acc) * cost', 'both')} FROM z"""


oracle(
    p7_median=f"WITH {F} SELECT id, {r6('list_median(v)', 'median')} FROM f",
    p8_renumber_groups=f"WITH {F}, g AS (SELECT id, min(id) OVER (PARTITION BY id % 3, label) AS first FROM f) SELECT id, dense_rank() OVER (ORDER BY first) AS grp FROM g",
    p9_separate_samples=f"""WITH {F}, {P}, b AS (SELECT sample, min(v[1]) AS lo, max(v[1]) AS hi FROM p GROUP BY 1),
      o AS (SELECT sample, coalesce(sum(hi + 0.5 * (hi - lo)) OVER (ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS o FROM b),
      h AS (SELECT id, sample, [v[1] + o, v[2]] AS v FROM p JOIN o USING (sample)) {cells('h', 'sample')}""",
    p10_jitter_width=f"""WITH {F}, {P}, {knn('e', 20, 'p', 'p', on='true')}, l AS (SELECT id AS j, unnest(v) AS x, unnest(range(2)) AS c FROM p),
      g AS (SELECT i, c, max(CASE WHEN rank = 1 THEN x END) - max(CASE WHEN rank = 20 THEN x END) AS d FROM e JOIN l USING (j) WHERE rank IN (1, 20) GROUP BY i, c)
      SELECT CAST(c AS INTEGER) AS c, {r6('3 * sum(abs(d)) / (SELECT count(*) FROM p)', 'width')} FROM g GROUP BY c""",
    p13_grid_cells=f"""WITH {F}, {P}, b AS (SELECT min(v[1]) AS ax, max(v[1]) AS bx, min(v[2]) AS ay, max(v[2]) AS cy_ FROM p)
      SELECT id, CAST(least(5, floor((v[1] - ax) / ((bx - ax) / 6))) AS INTEGER) AS cx, CAST(least(5, floor((v[2] - ay) / ((cy_ - ay) / 6))) AS INTEGER) AS cy FROM p, b""",
    j1_knn_euclidean=f"WITH {graph()} {EDGES} e",
    j1_knn_cosine=f"WITH {F}, {UNIT}, {knn('e', 15, 'u', 'u', f'greatest(0.0, 1.0 - {DOT})')} {EDGES} e",
    j1_knn_inner_product=f"WITH {F}, {knn('e', 15, 'f', 'f', f'1.0 - {DOT}')} {EDGES} e",
    j1_knn_train_test=f"WITH {F}, {knn('e', 5, 'f', 'f', on='a.id % 4 = 0 AND b.id % 4 > 0')} {EDGES} e",
    j4_filtered_knn=f"WITH {F}, {knn('e', 5, 'f', 'f', on='a.id <> b.id AND b.id % 3 = 0')} {EDGES} e",
    j5_grid_knn=f"WITH {F}, {P}, {knn('e', 10, 'p', 'p')} {EDGES} e",
    j6_nearest=f"WITH {F}, {P}, {knn('e', 1, 'p', 'p', on='a.sample = 1 AND b.sample = 0')} SELECT i, j, {r6('dist', 'dist')} FROM e",
    j7_self_graph_clamped=f"WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS id, [CAST(n_nationkey * 7 % 11 AS DOUBLE), CAST(n_nationkey * 5 % 13 AS DOUBLE)] AS v FROM nation), {knn('e', 100, 'p', 'p')} {EDGES} e",
    j9_normalize_graph=f"""WITH x AS (SELECT l_suppkey AS i, l_partkey % 120 AS j, round(min(CAST(l_tax AS DOUBLE)) - 0.04, 6) AS dist, min(l_orderkey * 10 + l_linenumber) AS was FROM lineitem GROUP BY 1, 2),
      y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY was, j) AS rank FROM x WHERE i <> j AND j IN (SELECT i FROM x)) SELECT i, CAST(rank AS INTEGER) AS rank, j, {r6('greatest(dist, 0.0)', 'dist')} FROM y WHERE rank <= 5""",
    j10_induced=f"WITH {graph()} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY rank, j) AS INTEGER) AS rank, j, {r6('dist', 'dist')} FROM e WHERE i % 2 = 0 AND j % 2 = 0",
    j11_interleave=f"""WITH {graph()}, {P}, {knn('n', 15, 'p', 'p')}, b AS (SELECT i, j, min(rank * 2 + src) AS key FROM (SELECT i, j, rank, 0 AS src FROM e UNION ALL SELECT i, j, rank, 1 FROM n) GROUP BY 1, 2),
      w AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY key, j) AS rank FROM b) SELECT i, CAST(rank AS INTEGER) AS rank, j, {r6('(key // 2) / 15.0', 'dist')} FROM w WHERE rank <= 15""",
    j12_project_labels=f"""WITH {graph(5)}, k AS (SELECT id, label FROM f WHERE id % 10 = 0), l AS (SELECT i, label, row_number() OVER (PARTITION BY i ORDER BY rank, j) AS r FROM e JOIN k ON k.id = e.j),
      c AS (SELECT i, label, count(*) AS n FROM l WHERE r <= 5 GROUP BY 1, 2), v AS (SELECT i AS id, arg_max(label, n * 1000 - label) AS label FROM c GROUP BY 1),
      h AS (SELECT e.i AS id, arg_min(v.label, e.rank) AS label FROM e JOIN v ON v.id = e.j GROUP BY 1), g AS (SELECT arg_max(label, n * 1000 - label) AS label FROM (SELECT label, count(*) AS n FROM k GROUP BY 1))
      SELECT f.id, coalesce(v.label, h.label, g.label) AS label FROM f LEFT JOIN v ON v.id = f.id LEFT JOIN h ON h.id = f.id, g WHERE f.id % 10 <> 0""",
    a1_vote="""WITH c AS (SELECT l_suppkey AS id, l_partkey % 7 AS label, count(*) AS n, round(sum(CAST(l_discount AS DOUBLE)), 9) AS s FROM lineitem GROUP BY 1, 2)
      SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, s DESC, label) AS r FROM c) WHERE r = 1""",
    a2_majority="""WITH c AS (SELECT l_suppkey AS grp, l_partkey % 7 AS label, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT grp, label FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label) AS r FROM c) WHERE r = 1""",
    a3_fold_fallback=f"""WITH {F}, c AS (SELECT a.fold, f.label, count(*) AS n FROM f, (SELECT DISTINCT id % 5 AS fold FROM f) a WHERE f.id % 5 <> a.fold GROUP BY 1, 2)
      SELECT fold, label FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, label) AS r FROM c) WHERE r = 1""",
    a4_accuracy=f"WITH {F}, {PRED} SELECT CAST(id % 5 AS INTEGER) AS fold, count(*) AS n, {r6('avg(CAST(truth = pred AS DOUBLE))', 'accuracy')} FROM q GROUP BY GROUPING SETS ((1), ())".replace("GROUPING SETS ((1), ())", "ROLLUP (CAST(id % 5 AS INTEGER))"),
    a5_confusion=f"WITH {F}, {PRED} SELECT truth, pred, count(*) AS n FROM q WHERE truth < 8 AND pred IN (SELECT truth FROM q WHERE truth < 8) GROUP BY 1, 2",
    a6_transitions=f"WITH {F}, {PRED} SELECT truth AS label, pred, count(*) AS n, count(*) FILTER (id % 3 <> 0) AS movable FROM q GROUP BY 1, 2",
    a7_objective=f"""WITH {F}, {PRED}, {_objective('q')}""",
    c10_objective_of_runs=f"""WITH {F}, {PRED}, one AS (SELECT 1 AS truth, 1 AS pred FROM q), every AS (SELECT id AS truth, id - id % 4 AS pred FROM q)
      {" UNION ALL ".join(f"SELECT '{n}' AS labels, * FROM (WITH {_objective(t)})" for n, t in (("as_is", "q"), ("one_class", "one"), ("a_class_a_row", "every")))}""",
    a8_lloyd_step=f"""WITH {F}, s AS (SELECT id, v, row_number() OVER (ORDER BY id) AS cluster FROM f ORDER BY id LIMIT 8),
      d AS (SELECT a.id, a.v, b.cluster, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.cluster) AS r FROM f a, s b),
      l AS (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS c FROM d WHERE r = 1) SELECT CAST(cluster AS INTEGER) AS cluster, CAST(c AS INTEGER) AS c, count(*) AS n, {r6('avg(x)', 'mean')} FROM l GROUP BY cluster, c""",
    a9_pass_messages=f"""WITH {F}, {P}, {knn('e', 15, 'p', 'p', on='a.sample = b.sample')}, t AS (SELECT e.*, p.sample, max(dist) OVER (PARTITION BY p.sample) AS top FROM e JOIN p ON p.id = e.i),
      l AS (SELECT id, unnest(v[1:4]) AS x, unnest(range(4)) AS c FROM f) SELECT i AS id, CAST(c AS INTEGER) AS c, {r6('sum(exp(CASE WHEN top > 0 THEN -dist / top ELSE 0.0 END) * x)', 'v')} FROM t JOIN l ON l.id = t.j GROUP BY i, c""",
    a10_column_stats=f"WITH {F}, l AS (SELECT unnest(v) AS x, unnest(range(64)) AS c FROM f) SELECT CAST(c AS INTEGER) AS c, count(*) AS n, {r6('avg(x)', 'mean')}, {r6('stddev_samp(x)', 'sd')}, {r6('min(x)', 'low')}, {r6('max(x)', 'high')} FROM l GROUP BY c",
    a10_gram=f"WITH {F}, l AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS c FROM f) SELECT CAST(a.c AS INTEGER) AS a, CAST(b.c AS INTEGER) AS b, {r6('sum(a.x * b.x)', 'v')} FROM l a JOIN l b ON a.id = b.id AND a.c <= b.c GROUP BY a.c, b.c",
)

DISSIMILAR = f"""{RUNS}, y AS (SELECT e.i, e.j, e.dist, count(*) FILTER (a.label <> 0 AND b.label <> 0) AS valid, count(*) FILTER (a.label <> 0 AND a.label = b.label) AS same
  FROM e JOIN r a ON a.id = e.i JOIN r b ON b.id = e.j AND a.run = b.run GROUP BY ALL),
  z AS (SELECT *, CASE WHEN same = 0 THEN 'infinity'::DOUBLE ELSE (1 + dist) / ((same / valid) * (same / valid)) END AS d FROM y)"""
UNDIRECTED = "w AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max({w}) AS w FROM e GROUP BY 1, 2)"
DISTANCE = UNDIRECTED.format(w="1 / (1 + dist)")
WEIGHTS = f"SELECT a, b, {r6('w', 'w')} FROM w"

oracle(
    a11_dissimilarity=f"WITH {graph()}, {DISSIMILAR} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INTEGER) AS rank, j, CASE WHEN same > 0 THEN round(d, 6) + 0.0 END AS dist, CAST(valid AS INTEGER) AS valid, CAST(same AS INTEGER) AS same FROM z",
    a12_components=f"""WITH RECURSIVE {graph(2)}, g AS (SELECT i AS a, j AS b FROM e WHERE rank = 1 UNION SELECT j, i FROM e WHERE rank = 1), c(id, root) AS (SELECT id, id FROM f UNION SELECT g.b, c.root FROM c JOIN g ON g.a = c.id)
      SELECT id, min(root) AS component FROM c GROUP BY id""",
    a13_modularity=f"""WITH {graph()}, {DISTANCE}, x AS (SELECT w, p.label AS la, q.label AS lb FROM w JOIN f p ON p.id = a JOIN f q ON q.id = b), m AS (SELECT sum(w) AS m, sum(CASE WHEN la = lb THEN w ELSE 0 END) AS inside FROM x),
      d AS (SELECT l, sum(w) AS d FROM (SELECT la AS l, w FROM x UNION ALL SELECT lb, w FROM x) GROUP BY l) SELECT {r6('max(inside / m) - sum((d / (2 * m)) * (d / (2 * m)))', 'modularity')} FROM d, m""",
    o1_folds_stratified=f"WITH {F}, {FOLDS(5)} SELECT * FROM fo",
    o1_folds_plain="SELECT o_orderkey AS id, CAST((row_number() OVER (ORDER BY md5('1:' || o_orderkey), o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM orders",
    o2_landmarks="""WITH c AS (SELECT c_nationkey AS stratum, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT sum(n) AS total, least(137, sum(n)) AS t FROM c),
      s AS (SELECT stratum, t * n // total AS quota, t * n % total AS rest, total, sum(t * n % total) OVER (ORDER BY stratum) AS cum FROM c, t),
      k AS (SELECT stratum, quota + ceil(cum / total - 0.5) - ceil((cum - rest) / total - 0.5) AS quota FROM s),
      r AS (SELECT c_custkey AS id, c_nationkey AS stratum, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('1:' || c_custkey), c_custkey) AS r FROM customer) SELECT id, stratum FROM r JOIN k USING (stratum) WHERE r <= quota""",
    o3_grid_landmarks=f"""WITH {F}, {P}, b AS (SELECT min(v[1]) AS ax, max(v[1]) AS bx, min(v[2]) AS ay, max(v[2]) AS cy_ FROM p),
      g AS (SELECT id, sample || ':' || printf('%06d', CAST(least(7, floor((v[1] - ax) / ((bx - ax) / 8))) AS INTEGER)) || ',' || printf('%06d', CAST(least(7, floor((v[2] - ay) / ((cy_ - ay) / 8))) AS INTEGER)) AS stratum FROM p, b),
      c AS (SELECT stratum, count(*) AS n FROM g GROUP BY 1), t AS (SELECT sum(n) AS total, least(60, sum(n)) AS t FROM c),
      s AS (SELECT stratum, t * n // total AS quota, t * n % total AS rest, total, sum(t * n % total) OVER (ORDER BY stratum) AS cum FROM c, t),
      k AS (SELECT stratum, quota + ceil(cum / total - 0.5) - ceil((cum - rest) / total - 0.5) AS quota FROM s),
      r AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('1:' || id), id) AS r FROM g) SELECT id, stratum FROM r JOIN k USING (stratum) WHERE r <= quota""",
    o5_top_by_score=f"SELECT p_partkey AS id, {r6('p_retailprice', 'score')}, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part ORDER BY rank LIMIT 100",
    o6_adjust_bh=f"""WITH o AS (SELECT o_orderkey AS id, round(pow(CAST('0x' || substr(md5('q:' || o_orderkey), 1, 4) AS INTEGER) / 65536.0, 3), 9) AS p FROM orders),
      r AS (SELECT id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM o), m AS (SELECT id, p, min(raw) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING) AS q FROM r),
      t AS (SELECT id, p, min(q) OVER (PARTITION BY p) AS q FROM m) SELECT id, {r6('p', 'p')}, {r6('least(1.0, q)', 'q')} FROM t""",
    o7_undirected_max=f"WITH {graph()}, {DISTANCE} {WEIGHTS}",
    o7_fuzzy_union=f"""WITH {graph()}, x AS (SELECT least(i, j) AS a, greatest(i, j) AS b, coalesce(max(CASE WHEN i < j THEN 1 / (1 + dist) END), 0.0) AS p, coalesce(max(CASE WHEN i > j THEN 1 / (1 + dist) END), 0.0) AS q FROM e GROUP BY 1, 2)
      SELECT a, b, {r6('p + q - p * q', 'w')} FROM x WHERE p + q - p * q > 1e-6""",
    o8_binary_union=f"WITH {graph()} SELECT i, j, 1.0::DOUBLE AS w FROM (SELECT i, j FROM e UNION SELECT j, i FROM e)",
    o11_repair_singletons=f"""WITH {F}, {P}, c AS (SELECT *, CASE WHEN id % 25 = 0 THEN id + 1000 ELSE (id // 50) * 2 + sample END AS cluster FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM c),
      a AS (SELECT * FROM n WHERE size = 1), b AS (SELECT * FROM n WHERE size > 1), {knn('e', 1, 'a', 'b', on='a.sample = b.sample')}
      SELECT n.id, coalesce(t.cluster, n.cluster) AS cluster FROM n LEFT JOIN e ON e.i = n.id LEFT JOIN n t ON t.id = e.j""",
)


def _votes(near: str, score: str, labels: str = "f") -> str:
    """Votes of near's edges (i, j, dist) among the folds fo: one row of (id, fold, truth, pred)."""
    return f"""c AS (SELECT i AS id, l.label, count(*) AS n, round(sum({score}), 9) AS s FROM {near} JOIN {labels} l ON l.id = j GROUP BY 1, 2),
      v AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, s DESC, label) AS r FROM c) WHERE r = 1),
      bc AS (SELECT a.fold, l.label, count(*) AS n FROM {labels} l JOIN fo ON fo.id = l.id, (SELECT DISTINCT fold FROM fo) a WHERE fo.fold <> a.fold GROUP BY 1, 2),
      fb AS (SELECT fold, label FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, label) AS r FROM bc) WHERE r = 1),
      out AS (SELECT l.id, fo.fold, l.label AS truth, coalesce(v.label, fb.label) AS pred FROM {labels} l JOIN fo ON fo.id = l.id LEFT JOIN v ON v.id = l.id LEFT JOIN fb ON fb.fold = fo.fold)"""


_CV = f"WITH {F}, {UNIT}, {FOLDS(10)}, uf AS (SELECT u.*, fold FROM u JOIN fo USING (id)), {knn('e', 10, 'uf', 'uf', f'greatest(0.0, 1.0 - {DOT})', 'a.fold <> b.fold')}, {_votes('e', '1 - dist')}"


def _cv_edges(k: int, take: int) -> str:
    return f"{graph(k)}, {FOLDS(5)}, n AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY rank, j) AS rank, j, dist FROM e JOIN fo a ON a.id = i JOIN fo b ON b.id = j WHERE a.fold <> b.fold), nn AS (SELECT i, CAST(rank AS INTEGER) AS rank, j, dist FROM n WHERE rank <= {take})"


oracle(
    c1_knn_cv=f"{_CV} SELECT * FROM out",
    c1_knn_cv_accuracy=f"{_CV} SELECT fold, count(*) AS n, {r6('avg(CAST(truth = pred AS DOUBLE))', 'accuracy')} FROM out GROUP BY ROLLUP (fold)",
    c3_cv_neighbours=f"WITH {_cv_edges(30, 10)} {EDGES} nn",
    c4_repredict=f"WITH {_cv_edges(12, 6)}, {PRED}, lab AS (SELECT id, pred AS label FROM q), {_votes('nn', '-dist * dist', 'lab')} SELECT * FROM out",
    c8_absorption_candidates=f"""WITH {F}, {PRED}, x AS (SELECT truth AS s, CAST(CASE WHEN truth < 4 THEN CAST(floor(truth + (id % 5) / 4.0) AS INTEGER) + 1 ELSE pred END AS INTEGER) AS t FROM q),
      n AS (SELECT s, t, count(*) AS n FROM x GROUP BY 1, 2), z AS (SELECT s, count(*) AS size FROM x GROUP BY 1), a AS (SELECT count(*) AS total FROM x),
      k AS (SELECT n.s, n.t, n.n, n.n - zs.size * zt.size / total AS surplus FROM n JOIN z zs ON zs.s = n.s JOIN z zt ON zt.s = n.t LEFT JOIN n st ON st.s = n.s AND st.t = n.s, a WHERE n.s <> n.t AND n.n > coalesce(st.n, 0)),
      r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(surplus, 9) DESC, t) AS r FROM k WHERE surplus > 0) SELECT s AS source, t AS target, n, {r6('surplus', 'surplus')} FROM r WHERE r = 1""",
    c14_laplacian_weights=f"""WITH {graph()}, m AS (SELECT i, list_sort(list(dist))[len(list(dist)) // 2 + 1] AS s FROM e GROUP BY i), x AS (SELECT e.i, e.j, exp(-dist * dist / (a.s * b.s)) AS g FROM e JOIN m a ON a.i = e.i JOIN m b ON b.i = e.j),
      w AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(g) AS w FROM x GROUP BY 1, 2), d AS (SELECT id, sum(w) AS d FROM (SELECT a AS id, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY id)
      SELECT a, b, {r6('w / sqrt(p.d * q.d)', 'w')} FROM w JOIN d p ON p.id = a JOIN d q ON q.id = b""",
    l7_pca_variance=f"WITH {F}, l AS (SELECT unnest(v) AS x, unnest(range(64)) AS c FROM f) SELECT {r6('sum(var)', 'total')}, 1.0::DOUBLE AS share FROM (SELECT var_samp(x) AS var FROM l GROUP BY c)",
    g1_weigh_distance=f"WITH {graph()}, {DISTANCE} {WEIGHTS} WHERE w > 0.05",
    g1_weigh_binary=f"WITH {graph()}, {UNDIRECTED.format(w='1.0::DOUBLE')} {WEIGHTS}",
    g1_weigh_adaptive=f"""WITH {graph()}, m AS (SELECT i, arg_max(dist, rank) AS s FROM e WHERE dist > 0 GROUP BY i), x AS (SELECT e.i, e.j, exp(-dist * dist / (coalesce(a.s, 1.0) * coalesce(b.s, 1.0))) AS g FROM e LEFT JOIN m a ON a.i = e.i LEFT JOIN m b ON b.i = e.j),
      w AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(g) AS w FROM x GROUP BY 1, 2) {WEIGHTS} WHERE w > 0.05""",
    g1_weigh_snn=f"""WITH {graph()}, s AS (SELECT a.i AS a, b.i AS b, count(*) AS s FROM e a JOIN e b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2), w AS (SELECT a, b, s / (30 - s) AS w FROM s) {WEIGHTS} WHERE w > 0.05""",
    g1_weigh_snn_mutual=f"""WITH {graph()}, m AS (SELECT x.i, x.j FROM e x JOIN e y ON x.i = y.j AND x.j = y.i), s AS (SELECT a.i AS a, b.i AS b, count(*) AS s FROM m a JOIN e b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2),
      w AS (SELECT a, b, s / (30 - s) AS w FROM s) {WEIGHTS} WHERE w > 0""",
    g1_weigh_odd_distances=f"""WITH {graph()}, o AS (SELECT i, j, CASE WHEN j % 5 = 0 THEN -dist WHEN j % 7 = 0 THEN 0.0 WHEN j % 11 = 0 THEN NULL ELSE dist END AS d FROM e),
      w AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(1 / (1 + d)) AS w FROM o WHERE d >= 0 GROUP BY 1, 2) {WEIGHTS}""",
    c14_laplacian_weights_zero_scales=f"""WITH {graph()}, o AS (SELECT i, j, CASE WHEN i % 3 = 0 AND rank < 10 THEN 0.0 ELSE dist END AS dist FROM e),
      m AS (SELECT i, list_sort(list(dist))[len(list(dist)) // 2 + 1] AS mid, avg(dist) AS mean FROM o GROUP BY i), c AS (SELECT i, greatest(CASE WHEN mid > 1e-6 THEN mid ELSE mean END, 1e-6) AS s FROM m),
      x AS (SELECT o.i, o.j, exp(-dist * dist / (a.s * b.s)) AS g FROM o JOIN c a ON a.i = o.i JOIN c b ON b.i = o.j),
      w AS (SELECT least(i, j) AS a, greatest(i, j) AS b, max(g) AS w FROM x GROUP BY 1, 2), d AS (SELECT id, sum(w) AS d FROM (SELECT a AS id, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY id)
      SELECT a, b, {r6('w / sqrt(p.d * q.d)', 'w')} FROM w JOIN d p ON p.id = a JOIN d q ON q.id = b""",
    g1_weigh_mutual=f"WITH {graph()}, w AS (SELECT x.i AS a, x.j AS b, greatest(1 / (1 + x.dist), 1 / (1 + y.dist)) AS w FROM e x JOIN e y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j) {WEIGHTS}",
)

_CONTINGENCY = f"{F}, {PRED}, n AS (SELECT truth, pred, count(*) AS n FROM q GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY truth) AS a, sum(n) OVER (PARTITION BY pred) AS b, sum(n) OVER () AS t FROM n)"
_CENTROIDS = "l AS (SELECT id, label, unnest(v) AS x, unnest(range(len(v))) AS c FROM f), m AS (SELECT label, c, avg(x) AS m, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT id, l.label, sum((x - m) * (x - m)) AS d2 FROM l JOIN m ON m.label = l.label AND m.c = l.c GROUP BY 1, 2)"
_OVERALL = "g AS (SELECT c, avg(x) AS g FROM l GROUP BY 1), o AS (SELECT sqrt(sum((x - g) * (x - g)) / (SELECT count(*) FROM f)) AS s FROM l JOIN g USING (c))"
_GAP = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_SILHOUETTE = f"""d AS (SELECT a.id, a.label, b.label AS k, avg({_GAP}) AS m FROM f a JOIN f b ON a.id <> b.id GROUP BY 1, 2, 3),
  y AS (SELECT id, label, max(m) FILTER (label = k) AS a, min(m) FILTER (label <> k) AS b FROM d GROUP BY 1, 2), t AS (SELECT label, CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM y)"""
_CONDUCTANCE = "u AS (SELECT li AS label, sum(1 / (1 + dist)) AS vol, sum(CASE WHEN li <> lj THEN 1 / (1 + dist) ELSE 0.0 END) AS cut FROM x GROUP BY li), v AS (SELECT label, cut / least(vol, (SELECT sum(vol) FROM u) - vol) AS q FROM u)"
_LABELED = "x AS (SELECT e.*, p.label AS li, q.label AS lj FROM e JOIN f p ON p.id = e.i JOIN f q ON q.id = e.j)"

oracle(
    v1_rand_index=f"""WITH {_CONTINGENCY}, s AS (SELECT sum(n * (n - 1) / 2) AS s, max(t) AS t FROM x), a AS (SELECT sum(a * (a - 1) / 2) AS a FROM (SELECT DISTINCT truth, a FROM x)), b AS (SELECT sum(b * (b - 1) / 2) AS b FROM (SELECT DISTINCT pred, b FROM x))
      SELECT {r6('(s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2))', 'ari')} FROM s, a, b""",
    v2_information=f"""WITH {_CONTINGENCY}, i AS (SELECT sum(n / t * ln(n * t / (a * b))) AS i FROM x), ha AS (SELECT -sum(a / t * ln(a / t)) AS ha FROM (SELECT DISTINCT truth, a, t FROM x)), hb AS (SELECT -sum(b / t * ln(b / t)) AS hb FROM (SELECT DISTINCT pred, b, t FROM x)),
      p AS (SELECT sum(m) / max(t) AS p FROM (SELECT pred, max(n) AS m, max(t) AS t FROM x GROUP BY pred)) SELECT {r6('i', 'mutual')}, {r6('i / ((ha + hb) / 2)', 'nmi')}, {r6('i / sqrt(ha * hb)', 'nmi_sqrt')}, {r6('i / ha', 'homogeneity')}, {r6('i / hb', 'completeness')},
      {r6('CASE WHEN i < 1e-12 THEN 0.0 ELSE 2 * (i / ha) * (i / hb) / (i / ha + i / hb) END', 'v_measure')}, {r6('p', 'purity')} FROM i, ha, hb, p""",
    v3_class_scores=f"""WITH {_CONTINGENCY}, r AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS r FROM x)
      SELECT truth, pred, CAST(a AS BIGINT) AS support, {r6('n / a', 'recall')}, {r6('n / b', 'precision')}, {r6('2 * (n / a) * (n / b) / (n / a + n / b)', 'dice')} FROM r WHERE r = 1""",
    v3_by_sample=f"""WITH {F}, {PRED}, g AS (SELECT CAST(id % 3 AS INTEGER) AS sample, truth, pred FROM q), n AS (SELECT sample, truth, pred, count(*) AS n FROM g GROUP BY ALL),
      x AS (SELECT *, sum(n) OVER (PARTITION BY sample, truth) AS a, sum(n) OVER (PARTITION BY sample, pred) AS b, sum(n) OVER (PARTITION BY sample) AS t FROM n),
      i AS (SELECT sample, max(t) AS t, sum(n / t * ln(n * t / (a * b))) AS i, sum(n * (n - 1) / 2) AS s, count(DISTINCT pred) AS clusters FROM x GROUP BY 1),
      ha AS (SELECT sample, -sum(a / t * ln(a / t)) AS ha, sum(a * (a - 1) / 2) AS pa FROM (SELECT DISTINCT sample, truth, a, t FROM x) GROUP BY 1), hb AS (SELECT sample, -sum(b / t * ln(b / t)) AS hb, sum(b * (b - 1) / 2) AS pb FROM (SELECT DISTINCT sample, pred, b, t FROM x) GROUP BY 1)
      SELECT sample, CAST(t AS BIGINT) AS n, {r6('(s - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))', 'ari')}, {r6('i / sqrt(ha * hb)', 'nmi')}, {r6('i / ha', 'homogeneity')}, {r6('i / hb', 'completeness')}, clusters FROM i JOIN ha USING (sample) JOIN hb USING (sample)""",
    v4_silhouette=f"""WITH {F}, {_SILHOUETTE} SELECT label, count(*) AS n, {r6('avg(s)', 'silhouette')} FROM t GROUP BY ROLLUP (label)""",
    v4_silhouette_summary=f"""WITH f AS (SELECT vec_id AS id, label % 4 AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), {_SILHOUETTE}, c AS (SELECT label, avg(s) AS s FROM t GROUP BY label)
      SELECT {r6('(SELECT avg(s) FROM t)', 'silhouette')}, {r6('(SELECT min(s) FROM c)', 'silhouette_class_min')}""",
    v5_scatter=f"""WITH {F}, {_CENTROIDS}, w AS (SELECT label, sum(d2) AS w, sqrt(avg(d2)) AS s, count(*) AS n FROM r GROUP BY 1), g AS (SELECT c, avg(x) AS g FROM l GROUP BY 1),
      b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM m JOIN g USING (c)), p AS (SELECT x.label, y.label AS o, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM m x JOIN m y ON x.c = y.c AND x.label <> y.label GROUP BY 1, 2),
      z AS (SELECT p.label, max((u.s + v.s) / d) AS r FROM p JOIN w u ON u.label = p.label JOIN w v ON v.label = p.o GROUP BY 1), a AS (SELECT sum(w) AS w, sum(n) AS n, count(*) AS k FROM w), y AS (SELECT avg(r) AS r FROM z),
      u AS (SELECT max(d) FILTER (label = o) AS intra, min(d) FILTER (label <> o) AS inter FROM (SELECT a.label, b.label AS o, {_GAP} AS d FROM f a JOIN f b ON a.id < b.id))
      SELECT {r6('w', 'within')}, {r6('b', 'between')}, {r6('(b / (k - 1)) / (w / (n - k))', 'calinski_harabasz')}, {r6('r', 'davies_bouldin')}, {r6('b / w', 'separation_ratio')}, {r6('inter / intra', 'dunn')} FROM a, b, y, u""",
    v6_neighbor_purity=f"""WITH {graph()}, {_LABELED}, y AS (SELECT i, avg(CAST(li = lj AS DOUBLE)) AS s FROM x GROUP BY i) SELECT count(*) AS n, {r6('avg(s)', 'purity')} FROM y""",
    v6_graph_purity=f"WITH {graph()}, {_LABELED}, y AS (SELECT i, count(*) AS n, sum(CAST(li = lj AS DOUBLE)) AS s FROM x GROUP BY i) SELECT CAST(sum(n) AS BIGINT) AS edges, {r6('sum(s) / sum(n)', 'purity')}, {r6('avg(s / n)', 'mean_row_purity')} FROM y",
    v6_compactness=f"WITH {F}, {_CENTROIDS}, {_OVERALL} SELECT label, count(*) AS n, {r6('sqrt(avg(d2))', 'rms')}, {r6('sqrt(avg(d2)) / (SELECT s FROM o)', 'normalized_rms')} FROM r GROUP BY 1",
    v6_truth_compactness=f"WITH {F}, {_CENTROIDS}, {_OVERALL}, z AS (SELECT label, sqrt(avg(d2)) / (SELECT s FROM o) AS q FROM r GROUP BY 1) SELECT {r6('median(q)', 'compactness')} FROM z",
    v7_conductance=f"WITH {graph()}, {_LABELED}, {_CONDUCTANCE} SELECT label, {r6('q', 'conductance')} FROM v",
    v7_conductance_summary=f"WITH {graph()}, {_LABELED}, {_CONDUCTANCE} SELECT {r6('avg(q)', 'mean')}, {r6('max(q)', 'maximum')} FROM v",
    v7_boundary_f1=f"""WITH {graph(3)}, {PRED}, x AS (SELECT a.truth <> b.truth AS t, a.pred <> b.pred AS p FROM e JOIN q a ON a.id = i JOIN q b ON b.id = j),
      s AS (SELECT count(*) FILTER (t AND p) / greatest(1, count(*) FILTER (p)) AS p, count(*) FILTER (t AND p) / greatest(1, count(*) FILTER (t)) AS r FROM x) SELECT {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('2 * p * r / (p + r)', 'f1')} FROM s""",
    v7_agreement_quantiles=f"""WITH {graph()}, {RUNS}, k AS (SELECT i, j, avg(CAST(a.label = b.label AS DOUBLE)) AS a FROM e JOIN r a ON a.id = i JOIN r b ON b.id = j AND b.run = a.run GROUP BY 1, 2)
      SELECT count(*) AS edges, {", ".join(r6(f"quantile_cont(a, {x / 100})", f"q{x}") for x in (0, 10, 25, 50, 75, 90, 100))} FROM k""",
    v8_fit_summary=f"""WITH {F}, {RUNS}, {TRACE}, l AS (SELECT run, arg_max(accuracy, cycle) AS a FROM t GROUP BY run), c AS (SELECT run, count(DISTINCT label) AS c, list(label ORDER BY id) AS s FROM r GROUP BY run),
      x AS (SELECT avg(a) AS m, median(a) AS md, stddev_samp(a) AS sd, min(a) AS lo, max(a) AS hi, count(*) AS runs FROM l), y AS (SELECT avg(c) AS m, median(c) AS md, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS iqr, avg(CAST(c <= 1 AS DOUBLE)) AS one, avg(CAST(c <= 2 AS DOUBLE)) AS two, count(DISTINCT s) AS s FROM c),
      z AS (SELECT avg(greatest(up, warm)) AS acc, avg(up) AS up, avg(warm) AS warm, avg(size) AS size, count(*) AS n FROM t)
      SELECT {r6('x.m', 'cv_mean')}, {r6('x.md', 'cv_median')}, {r6('x.sd', 'cv_sd')}, {r6('x.lo', 'cv_min')}, {r6('x.hi', 'cv_max')}, {r6('y.m', 'classes_mean')}, {r6('y.md', 'classes_median')}, {r6('y.iqr', 'classes_iqr')}, {r6('y.one', 'collapse_one_rate')}, {r6('y.two', 'collapse_two_rate')},
      y.s AS distinct_solutions, {r6('z.acc', 'acceptance_rate')}, {r6('z.up', 'improving_acceptance_rate')}, {r6('z.warm', 'temperature_acceptance_rate')}, {r6('z.size', 'proposal_size_mean')}, x.runs + z.n AS cv_evaluations FROM x, y, z""",
    v8_cycle_deciles=f"""WITH {TRACE}, d AS (SELECT *, CAST(least(10, greatest(1, ceil(10 * cycle / (SELECT max(cycle) FROM t)))) AS INTEGER) AS decile FROM t)
      SELECT decile, count(*) AS cycles, {r6('avg(size)', 'proposal_size')}, {r6('avg(active)', 'active_classes')}, {r6('avg(greatest(up, warm))', 'acceptance_rate')}, {r6('avg(up)', 'improving_rate')}, {r6('avg(warm)', 'temperature_rate')} FROM d GROUP BY decile""",
    v8_prefix_agreement=f"""WITH {graph()}, {RUNS}, x AS (SELECT i, j, a.run, CAST(a.label = b.label AS DOUBLE) AS s FROM e JOIN r a ON a.id = i JOIN r b ON b.id = j AND b.run = a.run), m AS (SELECT unnest([2, 4, 8]) AS m), y AS (SELECT m, i, j, avg(s) AS a FROM x JOIN m ON run <= m GROUP BY ALL)
      SELECT m AS prefix, count(*) AS edges, {r6('avg(a)', 'mean_agreement')}, {r6('stddev_samp(a)', 'sd_agreement')} FROM y GROUP BY m""",
    v8_best_run=f"WITH {TRACE}, l AS (SELECT run, arg_max(accuracy, cycle) AS a FROM t GROUP BY run) SELECT run, {r6('a', 'accuracy')} FROM l ORDER BY a DESC, run LIMIT 1",
    v8_classes_by_run=f"WITH {F}, {RUNS} SELECT run, count(DISTINCT label) AS classes FROM r GROUP BY run",
)
