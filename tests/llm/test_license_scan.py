"""op4: planted notices, altered ones, and text that only resembles them."""

import random
import textwrap

import pyarrow as pa
import pytest

from tessera.llm import license_scan as S


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    word = lambda: "".join(rng.choices(["the", "er", "ing", "of", "to", "ba", "lo", "an"], k=rng.randrange(1, 4)))
    return S.train([" ".join(word() for _ in range(30)) for _ in range(300)] + ["the license of the work is under the terms of a public library", "permission to use the file"])


def found(model, text):
    return next(S.findings(model, pa.array([text])))


def test_every_template_is_found(model):
    for family, texts in S.TEMPLATES.items():
        for t in texts:
            got = found(model, f"Some words before.\n  {t}\nand after é")
            assert [x["family"] for x in got] == [family], t
            assert f"Some words before.\n  {t}\nand after é"[got[0]["start"] : got[0]["end"]] == f"  {t}"


def test_altered_and_alike(model):
    assert found(model, "é released UNDER the mit license!")[0]["family"] == "MIT"
    assert found(model, "this work is now licensed under the GNU General Public License version 3")[0]["family"] == "GPL"
    for t in ("", "the licence was lost", "he was licensed to drive in the public park of the city", "mit der version 2 0", "we use the file in the terms of the work", "apache helicopters"):
        assert found(model, t) == []
    long = "word " * 200_000
    assert [x["family"] for x in found(model, long + "\nLicensed under CC BY-NC 4.0.\n" + long)] == ["CC-BY-NC"]


@pytest.mark.parametrize("marker", ["", " * ", "// ", "# ", "dnl "])
@pytest.mark.parametrize("width", [40, 60, 76])
def test_wrapped_templates_are_found(model, marker, width):
    for family, texts in S.TEMPLATES.items():
        for t in texts:
            lines = textwrap.wrap(t, width, break_on_hyphens=False)
            body = "\n".join(marker + x for x in lines)
            text = f"{marker}A file é.\n{marker.rstrip() if marker != 'dnl ' else ''}\n{body}\n\n{marker}the words after"
            got = found(model, text)
            assert {x["family"] for x in got} == {family}, (t, got)
            assert body.startswith(text[got[0]["start"] : got[-1]["end"]]) or text[got[0]["start"] : got[-1]["end"]] in body


def test_every_family_of_a_line_is_found(model):
    mit, apache, bsd = S.TEMPLATES["MIT"][2], S.TEMPLATES["Apache-2.0"][1], S.TEMPLATES["BSD"][2]
    for text in (f"{mit} {apache}", f"some words {bsd} and more words of others {mit} the end {apache}"):
        got = found(model, text)
        assert {x["family"] for x in got} == {f for f, t in (("MIT", mit), ("Apache-2.0", apache), ("BSD", bsd)) if t in text}
        assert all((x["start"], x["end"]) == (0, len(text)) for x in got)
    words = mit.split()
    assert found(model, " ".join(words[:13]) + "\n\n" + " ".join(words[13:])) == []  # two paragraphs, neither with enough of it


def test_scan(spark, model):
    rows = [(1, "x\nReleased under the MIT License.", "a"), (2, None, "b"), (None, "Released under the MIT License.", "c"), (2, "", "d"), (1, "x\nReleased under the MIT License.", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = S.scan(df, model).collect()
    assert sorted((str(r.doc_id), [(x.family, x.start, x.end) for x in r.licences]) for r in got) == [("1", [("MIT", 2, 33)])] * 2 + [("2", [])] * 2 + [("None", [("MIT", 0, 31)])]
    assert S.scan(df.limit(0)).collect() == []


def test_denied_notices(model):
    families = lambda t: [f["family"] for f in found(model, t)]
    assert families("This work is licensed under the GNU General Public License, version 3.") == ["GPL"]
    assert families("This work is not licensed under the GNU General Public License, version 3.") == []
    assert families("This work is not\nlicensed under the GNU General Public License, version 3.") == []
    assert families("This work is never distributed or licensed under the GNU General Public License, version 3.") == []
    assert families("This file isn't licensed under the Apache License, Version 2.0.\n\nReleased under the MIT License.") == ["MIT"]
    assert families("We do not like it. This work is licensed under the GNU General Public License, version 3.") == ["GPL"]


def test_short_notices(model):
    families = lambda t: [f["family"] for f in found(model, t)]
    assert families("All rights reserved.") == ["Proprietary"] and families("Copyright 2020 by the authors. All rights reserved.") == ["Proprietary"]
    assert families("some words\nAll rights reserved.\nother words") == ["Proprietary"]
    assert families("all of the rights that we reserved") == [] and families("rights reserved seats all") == []
