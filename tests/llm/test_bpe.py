"""op8 against the tiktoken library; appends and edits against encoding afresh."""

import hashlib
import random

import pytest
import tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(0)
    out = ["", " ", "  a\n\n b  \x85\xa0 x\x1c\x1dy  z", "日本語のテキスト１２３ ½", "aaaaaaaaaaaaaaa'sss'll", " " * 50, "a" * 5000, "é ǅ ɐ", "😀 👩‍👩‍👧", "<|endoftext|> hi"]
    out += ["".join(rng.choice("abcdeéñ 0123.,!?'\n\t\xa0\x1f日ⅷ²") for _ in range(rng.randrange(200))) for _ in range(150)]
    return out + ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x11000), rng.randrange(128)])) for _ in range(60)) for _ in range(80)]


def test_encode_and_decode(spark, library):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts())] + [(900, None, 0, "x"), (900, None, 0, "x"), (None, "a b", 0, "x"), (901, "word " * 40_000, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    got = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    once = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in once) == want
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_appends_and_edits(ranks, library):
    v = bpe.Vocabulary(ranks)
    rng = random.Random(1)
    fresh = lambda data: bpe.Prefixes(v, data).tokens()
    for _ in range(40):
        word = bytes(rng.choice(b"abcdeinrstuABE ") for _ in range(rng.randrange(1, 120)))
        p = bpe.Prefixes(v, word)
        assert p.tokens() == library._core_bpe.encode_single_piece(word)
        p.append(b"ation")
        assert p.tokens() == fresh(word + b"ation")
        a = rng.randrange(len(word) + 1)
        b = rng.randrange(a, len(word) + 1)
        p.edit(a, b, b"ther")
        assert p.data == (word + b"ation")[:a] + b"ther" + (word + b"ation")[b:]
        assert p.tokens() == fresh(p.data) and len(p.last) == len(p.data) + 1
    long = bpe.Prefixes(v, b"the cat sat on the mat " * 200)
    assert long.edit(40, 41, b"x") < 1000 and long.tokens() == fresh(long.data)


def test_a_state_asks_only_for_tokens_that_end_there(ranks, library):
    class Asked(dict):
        asked = 0

        def get(self, *key):
            Asked.asked += 1
            return super().get(*key)

    v = bpe.Vocabulary(Asked(ranks))
    rng = random.Random(2)
    for _ in range(60):
        word = bytes(rng.choice(b"abcdeinrst \xc3\xa9\xff") for _ in range(rng.randrange(1, 90)))
        Asked.asked = 0
        p = bpe.Prefixes(v, word)
        assert Asked.asked <= len(word) and p.tokens() == library._core_bpe.encode_single_piece(word)
        for end in range(1, len(word) + 1):
            here = [word[a:end] for a in range(max(0, end - v.longest), end)]
            assert [t for _, t, _ in p.nodes[end][1]] == [ranks[b] for b in here if b in ranks]
    with pytest.raises(ValueError):
        bpe.Prefixes(bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2}), b"abab c")


def test_query(spark, tmp_path, library):
    from tessera.llm.queries import op8_byte_bpe

    spark.createDataFrame([(1, "Hello world, é"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_byte_bpe(spark, str(tmp_path)).collect()}
    ids = library.encode_ordinary("Hello world, é")
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256("Hello world, é".encode()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
