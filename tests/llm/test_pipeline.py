"""The pipeline against a brute-force version on a small fixture."""

import hashlib
import random
import sys

import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import bpe  # noqa: E402

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_decontaminate import brute as contaminated  # noqa: E402
from test_ngram_join import brute as classes  # noqa: E402
from test_pii import PLAIN, brute as private  # noqa: E402


def test_run(spark, tmp_path):
    rng = random.Random(9)
    say = {"en": ["the", "thing", "with", "other", "water", "house"], "de": ["der", "schön", "nicht", "ungen", "wasser", "haus"]}
    items = [(i, " ".join(rng.choices(say["en"], k=20)) + f" item{i}") for i in range(5)]
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        words = rng.choices(say[lang], k=60)
        if i % 10 == 0:
            words[10:10] = [rng.choice(["a.b@mail.com", "10.1.2.3", "4111 1111 1111 1111", "+1 (234) 555-1234"])]
        if i % 17 == 0:
            words[20:20] = rng.choice(items)[1].split()
        if i % 34 == 0:  # a passage far below a twentieth of its document
            words += rng.choices(say[lang], k=900)
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 0))
    rows += [(200 + i, rows[i * 3][1], rows[i * 3][2], "copy", 0) for i in range(10)]
    rows += [(300, None, "en", None, None), (301, "", None, "x", 0), (302, "123 456", "de", "x", 0), (303, " \n", "en", "x", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    ids = {d for d, _, c in classes(kept) if d == c}
    kept = [(d, t) for d, t in kept if d in ids]
    clean = {d for d, _, n_hit, _, _ in contaminated(kept, items) if not n_hit}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for d, t in kept:
        if d in clean:
            for kind, a, b in sorted(private(t), key=lambda s: -s[1]):
                t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
            want[d] = (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r["ids"], r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(PLAIN) == 4 and 60 < len(want) < 130


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, "some text", None, None, None), (None, "more text", "en", "x", 9)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()


def test_extra_columns_of_any_name(spark, tmp_path):
    names = ("score", "languages", "lang_pred", "_text", "kept_text", "_row", "_added", "added", "_bit", "place", "hash", "uid", "spans", "n_words", "n_hit", "items", "decoded", "ids", "n_tokens", "component_id", "fp", "x")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"some text of number {i} or so", "en", "s", 9, *(f"{n}{i}" for n in names)) for i in range(4)] + [(0, "some text of number 0 or so", "en", "s", 9, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert sorted(tuple(r)[5:] for r in docs.where("doc_id > 0").collect()) == [tuple(f"{n}{i}" for n in names) for i in (1, 2, 3)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 4


def test_no_language_learned_keeps_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for langs in ((None, None), (None, "en")):  # the second row has no id, so nothing is learned from it
        rows = [(1, "some text", langs[0], None, None), (None, "more words é", langs[1], "x", 9), (2, "12 34", None, None, None), (3, None, None, None, None), (4, "", None, None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert sorted(r.text for r in docs.collect()) == ["more words é", "some text"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 2


def test_rows_are_deduplicated_one_by_one(spark):
    copy, other, third = ("one two three four five six seven", "a text of its own with other words", "the third text has no number at all")
    rows = [(1, copy), (1, copy), (7, copy), (7, other), (None, third), (None, third), (9, None), (9, None), (None, ""), (8, copy), (None, copy), (5, third + " x " * 9)]
    docs = spark.createDataFrame([(i, t, None, f"s{i}", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    want = [(1, copy), (7, other), (None, third), (9, None), (9, None), (None, ""), (5, third + " x " * 9)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
