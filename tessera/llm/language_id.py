"""Language identification as inference of a mixture of languages.

Every word of a text is drawn from one of the languages, with the likelihood of its letter trigrams (of
bytes, hashed) under that language; expectation-maximisation estimates the document's proportions. The
set of languages is the one of the highest penalised likelihood among the best single language and the
2, 3, ... languages of the highest proportions, as long as they have LEAST of the words: each further
language costs half the logarithm of the number of words, and EXTRA.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .text_kernel import chunks

#: Buckets of trigrams; the model takes 4 bytes for each bucket and language.
BUCKETS = 1 << 16
#: Added to each bucket's count; trigrams overlap, so a word's log-likelihood is divided by three.
SMOOTH, OVERLAP = 0.5, 3.0
#: Steps of expectation-maximisation, the share from which a language is one of a document's, and the cost of each beyond the first.
STEPS, LEAST, EXTRA = 12, 0.02, 3.0
#: A word's log-likelihood under a language counts as at most so far below that under its likeliest.
FLOOR = -60.0
#: Bytes of text handled at once.
CHUNK = 1 << 20
UNDETERMINED = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, first letter of each word, first word of each text)."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 2, 32, np.uint8)  # a space before each text
    doc = np.repeat(np.arange(1, n + 1), np.diff(offsets))
    padded[np.arange(len(data)) + doc] = _LETTERS[data]
    at = np.flatnonzero(padded != 32)
    p = padded.astype(np.uint32)
    with np.errstate(over="ignore"):
        bucket = (p[at - 1] * np.uint32(2654435761) + p[at] * np.uint32(2246822519) + p[at + 1] * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(16)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    begin = offsets[:-1] + np.arange(n) + 1  # where each text begins in padded
    return bucket, starts, np.append(np.searchsorted(at[starts], begin), len(starts))


def fit(pairs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of buckets x languages, from all rows of (text, lang) with a lang."""
    rows = pairs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, data, offsets in chunks(batch.column(0), CHUNK):
                bucket, starts, first = trigrams(data, offsets)
                letters = np.append(starts, len(bucket))[first]
                for lang in set(langs[a:b]):
                    held = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own = np.repeat(langs[a:b] == lang, np.diff(letters))
                    held += np.bincount(bucket[own], minlength=BUCKETS)
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * max(1, len(at))), pa.array(at if len(at) else [0]), pa.array(held[at] if len(at) else [0])], ["lang", "bucket", "n"])

    prepare(pairs.sparkSession)
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    model = np.full((BUCKETS, len(langs)), SMOOTH)
    if langs:
        column = {x: i for i, x in enumerate(langs)}
        np.add.at(model, (counts["bucket"].to_numpy(), np.array([column[x] for x in counts["lang"].to_pylist()])), counts["n"].to_numpy())
    return langs, np.log(model / model.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, cuts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text (texts have words: cuts are the first ones)."""
    words = np.diff(np.append(cuts, len(doc)))[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        joint = like * share[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, cuts, axis=0) / words
    return share, np.add.reduceat(np.log((like * share[doc]).sum(axis=1)), cuts)


def mixtures(ll: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts x languages: proportions over the chosen set of languages; zeros for texts without words."""
    out = np.zeros((len(first) - 1, ll.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if not len(some) or not ll.shape[1]:
        return out
    cuts, words = first[some], np.diff(first)[some]
    doc = np.repeat(np.arange(len(some)), words)
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(ll - top, FLOOR))
    alone = np.add.reduceat(np.log(like), cuts, axis=0)
    best = alone.max(axis=1)
    result = np.zeros((len(some), ll.shape[1]))
    result[np.arange(len(some)), alone.argmax(axis=1)] = 1.0
    share, _ = _em(like, doc, cuts, np.ones_like(result))
    order = np.argsort(-share, axis=1, kind="stable")
    cost = 0.5 * np.log(words + 1.0) + EXTRA
    for k in range(2, ll.shape[1] + 1):
        may = np.flatnonzero(share[np.arange(len(some)), order[:, k - 1]] >= LEAST)
        if not len(may):
            break
        allowed = np.zeros((len(may), ll.shape[1]))
        np.put_along_axis(allowed, order[may, :k], 1.0, axis=1)
        picked = np.zeros(len(some), bool)
        picked[may] = True
        sub, n = picked[doc], words[may]
        s, value = _em(like[sub], np.repeat(np.arange(len(may)), n), np.cumsum(n) - n, allowed)
        value -= (k - 1) * cost[may]
        better = value > best[may]
        best[may[better]], result[may[better]] = value[better], s[better]
    out[some] = result
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, (columns to keep, as kept_<name>), lang_pred, score, languages array<struct<lang, share>>.

    languages: the chosen set with its proportions, largest first; lang_pred is the first of them and
    score its proportion. A null text, one without a letter (Unicode category L), and any text if no
    language was learned: lang_pred 'und', score 0, no languages. Letters of a text all of whose bytes
    are unknown to every language still choose the likeliest. Ties go to the language that sorts first.
    Repeated rows give as many rows, an empty table none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1] / np.float32(OVERLAP))  # 256 KB for each language
    kept = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            shares = []
            for _, _, data, offsets in chunks(batch.column(0), CHUNK):
                bucket, starts, first = trigrams(data, offsets)
                ll = np.add.reduceat(table[bucket], starts, axis=0).astype(np.float64) if len(starts) else np.zeros((0, len(langs)))
                shares.append(mixtures(ll, first))
            share = np.concatenate(shares) if shares else np.zeros((0, len(langs)))
            preds, scores, sets = [], [], []
            for text, s in zip(batch.column(0), share, strict=True):
                on = [i for i in np.argsort(-s, kind="stable").tolist() if s[i] > 0]
                if not on or not any(map(str.isalpha, text.as_py())):
                    preds.append(UNDETERMINED), scores.append(0.0), sets.append([])
                else:
                    preds.append(langs[on[0]]), scores.append(min(1.0, float(s[on[0]]))), sets.append([{"lang": langs[i], "share": float(s[i])} for i in on])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], [*batch.schema.names[1:], "lang_pred", "score", "languages"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
