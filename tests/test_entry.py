import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_query_has_a_name_and_sql_belongs_to_one():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["id", "fold", "truth", "pred"] and out.count() == 500


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_core_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name in ("j1_knn_euclidean", "c1_knn_cv", "a11_dissimilarity", "p4_normalize_pqn", "o2_landmarks", "v2_information"):
        df = entry.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        got = sorted(str([str(r[c]) for c in cols]) for r in df.collect())
        found = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in cols]
        assert got == sorted(str([str(r[i]) for i in at]) for r in found.fetchall()), name
