"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of WINDOW words of a benchmark item (a shorter item is one window). A window is the
set of its SHINGLE-word shingles with their places; a document that holds the window holds all of
them. So shingles are ordered by rarity (how often each occurs in all documents) and the join runs on
the one prefix token that containment needs: the window's rarest shingle. A match at word p of a
document, of a shingle at place o of a window of n words, is kept if the window fits (0 <= p - o and
p - o + n <= words of the document: positional and length bounds) and verified by comparing all n words
(their 64-bit hashes). Windows of a small benchmark are held in every task; those of a larger one are a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitfilter import BITS, bits_of, is_on
from .runtime import prepare, written
from .text_kernel import ALNUM, LOWER, chunks, joined, run_positions, word_hashes, words

WINDOW, SHINGLE = 13, 4
#: Bytes of item texts up to which a benchmark is held in every task; a larger one is joined by token.
BLOCK_BYTES = 8 << 20


@dataclass
class Windows:
    """The distinct windows of a block of items, by length, and the items that hold each."""

    length: np.ndarray  # words of window w
    first: np.ndarray  # its place in hashes
    hashes: np.ndarray  # word hashes of all windows, one after another
    items: list[str]  # item ids
    holds: np.ndarray  # pairs (window, item), by window
    cuts: np.ndarray  # window w's pairs are cuts[w]:cuts[w + 1]


def parsed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, first word of each row) of texts' lower-cased words."""
    for a, b, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, ALNUM)
        yield a, b, word_hashes(data, starts, ends), first


def windows_of(items: list[tuple[str, str]]) -> Windows:
    found: dict[bytes, set[int]] = {}
    ids: dict[str, int] = {}
    column = pa.array([t for _, t in items], pa.large_string())
    for a, b, h, first in parsed(column):
        for i in range(a, b):
            own = h[first[i - a] : first[i - a + 1]]
            if not len(own):
                continue
            item = ids.setdefault(items[i][0], len(ids))
            for k in range(max(1, len(own) - WINDOW + 1)):
                found.setdefault(own[k : k + WINDOW].tobytes(), set()).add(item)
    length = np.array([len(w) // 8 for w in found], np.int64)
    holds = np.array([(w, i) for w, s in enumerate(found.values()) for i in sorted(s)], np.int64).reshape(-1, 2)
    return Windows(length, np.cumsum(length) - length, np.frombuffer(b"".join(found), np.uint64), list(ids), holds, np.searchsorted(holds[:, 0], np.arange(len(length) + 1)))


def shingle_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, SHINGLE)


def window_shingles(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place, shingle) of every shingle of every window."""
    size = shingle_size(w.length)
    count = w.length - size + 1
    window, place = np.repeat(np.arange(len(count)), count), run_positions(count)
    value = np.empty(len(window), np.uint64)
    for k in np.unique(size):
        every = joined(w.hashes, int(k))
        at = np.flatnonzero(size[window] == k)
        value[at] = every[w.first[window[at]] + place[at]]
    return window, place, value


def _bitmap(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return out


def _matches(h: np.ndarray, first: np.ndarray, values: np.ndarray, sizes: np.ndarray, bitmaps: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word place, document, index into values) where a shingle of the sorted values starts within a document."""
    for k, bitmap in bitmaps.items():
        run = joined(h, k)
        at = np.flatnonzero(bitmap[(run & np.uint64((1 << 20) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(values, run[at]), len(values) - 1)
        ok = (values[i] == run[at]) & (sizes[i] == k)
        at, i = at[ok], i[ok]
        doc = np.searchsorted(first, at, side="right") - 1
        ok = at + k <= first[doc + 1]
        yield at[ok], doc[ok], i[ok]


def _sized(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    values, at = np.unique(values, return_index=True)
    sizes = sizes[at]
    return values, sizes, {int(k): _bitmap(values[sizes == k]) for k in np.unique(sizes)}


def _counts(values: np.ndarray, sizes: np.ndarray, bitmaps: dict[int, np.ndarray]):
    """How often each shingle occurs in a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            for _, _, h, first in parsed(batch.column(0)):
                for _, _, i in _matches(h, first, values, sizes, bitmaps):
                    total += np.bincount(i, minlength=len(values))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    return run


def _scan(w: Windows, values: np.ndarray, sizes: np.ndarray, bitmaps: dict[int, np.ndarray], cuts: np.ndarray, window: np.ndarray, place: np.ndarray, kept: int):
    """Rows of documents with n_words, the hit spans (in words, end exclusive) and the items of occurring windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for a, b, h, first in parsed(batch.column(1)):
                n_words += np.diff(first).tolist()
                at_all, w_all, d_all = [], [], []
                for at, doc, i in _matches(h, first, values, sizes, bitmaps) if len(values) else ():
                    n = cuts[i + 1] - cuts[i]  # windows that a token is the prefix of
                    at, doc = np.repeat(at, n), np.repeat(doc, n)
                    j = np.repeat(cuts[i], n) + run_positions(n)
                    win, start = window[j], at - place[j]
                    ok = (start >= first[doc]) & (start + w.length[win] <= first[doc + 1])
                    win, start, doc = win[ok], start[ok], doc[ok]
                    same = np.ones(len(win), bool)
                    for k in range(WINDOW):
                        long = np.flatnonzero(same & (w.length[win] > k))
                        same[long] = h[start[long] + k] == w.hashes[w.first[win[long]] + k]
                    at_all.append(start[same]), w_all.append(win[same]), d_all.append(doc[same])
                own_spans: list[list] = [[] for _ in range(b - a)]
                own_items: list[list] = [[] for _ in range(b - a)]
                if at_all and sum(map(len, at_all)):
                    start, win, doc = map(np.concatenate, (at_all, w_all, d_all))
                    step = np.zeros(len(h) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + w.length[win], -1)
                    hit = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
                    hit_doc = np.repeat(np.arange(b - a), np.diff(first))
                    cut = np.zeros(len(h) + 1, bool)
                    cut[first] = True  # a document's end ends a span
                    begins = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:-1]))
                    ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:])) + 1
                    for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                        d = int(hit_doc[x])
                        own_spans[d].append({"first": x - int(first[d]), "end": y - int(first[d])})
                    n = w.cuts[win + 1] - w.cuts[win]
                    pairs = np.stack([np.repeat(doc, n), w.holds[np.repeat(w.cuts[win], n) + run_positions(n), 1]])
                    for d, i in np.unique(pairs, axis=1).T.tolist():
                        own_items[d].append(w.items[i])
                spans += own_spans
                items += own_items
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2 : 2 + kept], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                ["uid", *batch.schema.names[2 : 2 + kept], "n_words", "spans", "items"],
            )

    return run


def _against(docs: DataFrame, items: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    w = windows_of(items)
    window, place, value = window_shingles(w)
    size = shingle_size(w.length)[window]
    values, sizes, bitmaps = _sized(value, size) if len(value) else (value, size, {})
    if len(values):
        counted = docs.select("text").mapInArrow(_counts(values, sizes, bitmaps), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        often = np.zeros(len(values), np.int64)
        counted = counted.toArrow()  # at most one row for each shingle of the block
        often[counted["token"].to_numpy()] = counted["n"].to_numpy()
        order = np.lexsort((value, often[np.searchsorted(values, value)], window))
        rarest = order[np.concatenate([[True], np.diff(window[order]) > 0])]
        rarest = rarest[often[np.searchsorted(values, value[rarest])] > 0]  # what occurs nowhere hits nothing
        window, place, value, size = window[rarest], place[rarest], value[rarest], size[rarest]
        order = np.argsort(value, kind="stable")
        window, place, value, size = window[order], place[order], value[order], size[order]
        values, sizes, bitmaps = _sized(value, size) if len(value) else (value, size, {})
    cuts = np.searchsorted(value, values, "left") if len(values) else np.zeros(0, np.int64)
    cuts = np.append(cuts, len(value))
    rows = docs.select("uid", "text", *keep)
    extra = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[2:])
    schema = f"uid long, {extra}n_words long, spans array<struct<first:int,end:int>>, items array<string>"
    return rows.mapInArrow(_scan(w, values, sizes, bitmaps, cuts, window, place, len(keep)), schema)


# A benchmark of any size: windows, tokens and candidates are tables, joined by token.


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, the word hashes of each of its windows)."""
    for batch in batches:
        for a, b, h, first in parsed(batch.column(1)):
            item, window = [], []
            ids = batch.column(0).slice(a, b - a).to_pylist()
            for i in range(b - a):
                own = h[first[i] : first[i + 1]]
                found = {own[k : k + WINDOW].tobytes() for k in range(max(1, len(own) - WINDOW + 1))} if len(own) else ()
                item += [ids[i]] * len(found)
                window += found
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.binary())], ["item", "window"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window's shingles: (window, token, place, words of the token)."""
    for batch in batches:
        own = batch.column(0).to_pylist()
        length = np.array([len(x) // 8 for x in own], np.int64)
        w = Windows(length, np.cumsum(length) - length, np.frombuffer(b"".join(own), np.uint64), [], np.empty((0, 2), np.int64), np.zeros(len(own) + 1, np.int64))
        at, place, value = window_shingles(w) if len(own) else (np.empty(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(value.view(np.int64)), pa.array(place), pa.array(shingle_size(length)[at])], ["window", "token", "place", "size"])


def _found(h: np.ndarray, first: np.ndarray, sizes: list[int], bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word place, document, token) of the shingles within a document whose bits are on."""
    out = []
    for k in sizes:
        run = joined(h, k)
        at = np.flatnonzero(is_on(bits, (run & np.uint64(BITS - 1)).astype(np.int64))) if len(run) else np.empty(0, np.int64)
        doc = np.searchsorted(first, at, side="right") - 1
        ok = at + k <= first[doc + 1]
        out.append((at[ok], doc[ok], run[at[ok]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _frequencies(sizes: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, first in parsed(batch.column(0)):
                token, n = np.unique(_found(h, first, sizes, bits.value)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])

    return run


def _candidates(sizes: list[int], bits):
    """(uid, text) -> (uid, number of words, null ...) for each document; (uid, word place, token, words before and after that a window may reach, those words) where a window may occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "n", "token", "before", "after", "around"]
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for a, b, h, first in parsed(batch.column(1)):
                none = [pa.nulls(b - a, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(uid[a:b]), pa.array(np.diff(first)), *none], names)
                at, doc, token = _found(h, first, sizes, bits.value)
                before, after = np.minimum(at - first[doc], WINDOW - 1), np.minimum(first[doc + 1] - at, WINDOW)
                for c in range(0, len(at), 16_384):
                    part = slice(c, c + 16_384)
                    around = [h[x - y : x + z].tobytes() for x, y, z in zip(at[part].tolist(), before[part].tolist(), after[part].tolist(), strict=True)]
                    columns = (uid[a:b][doc[part]], at[part] - first[doc[part]], token[part], before[part], after[part])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(around, pa.binary())], names)

    return run


def _joined(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(uid, n_words, spans, items) of docs(uid, text): two passes over the documents, whatever the benchmark's size."""
    held = written(bench.mapInArrow(_item_windows, "item string, window binary").distinct(), "windows")
    tokens = written(held.select("window").distinct().mapInArrow(_tokens, "window binary, token long, place long, size long"), "tokens")
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect())  # at most SHINGLE
    bit = F.col("token").bitwiseAND(F.lit(BITS - 1))
    often = docs.select("text").mapInArrow(_frequencies(sizes, bits_of(tokens, bit)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct("n", "token", "place")).alias("r")
    prefix = tokens.join(often, "token", "left").fillna(0, ["n"]).groupBy("window").agg(rarest).where("r.n > 0").select("window", "r.token", "r.place")
    prefix = written(prefix, "prefixes")
    rows = docs.select("uid", "text").mapInArrow(_candidates(sizes, bits_of(prefix, bit)), "uid long, n long, token long, before long, after long, around binary")
    rows = written(rows, "candidates")
    start, words = F.col("n") - F.col("place"), F.length("window") / 8
    fits = (F.col("place") <= F.col("before")) & (words - F.col("place") <= F.col("after"))
    same = F.expr("substring(around, cast((before - place) * 8 + 1 as int), length(window))") == F.col("window")
    hits = rows.where("token is not null").join(prefix, "token").where(fits & same).select("uid", start.alias("first"), (start + words.cast("long")).alias("end"), "window")
    hits = written(hits, "hits")
    spans = hits.select("uid", F.struct(F.col("first").cast("int").alias("first"), F.col("end").cast("int").alias("end")).alias("s")).distinct().groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    items = hits.select("uid", "window").distinct().join(held, "window").select("uid", "item").distinct().groupBy("uid").agg(F.collect_list("item").alias("items"))
    merged = """aggregate(spans, cast(array() as array<struct<first:int,end:int>>), (done, s) ->
      if(size(done) > 0 and element_at(done, -1).end >= s.first,
         concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'end', greatest(element_at(done, -1).end, s.end)))),
         concat(done, array(s))))"""
    out = rows.where("token is null").select("uid", F.col("n").alias("n_words")).join(spans, "uid", "left").join(items, "uid", "left")
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select("uid", "n_words", some(F.expr(merged), "array<struct<first:int,end:int>>").alias("spans"), some(F.col("items"), "array<string>").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, (columns to keep, as kept_<name>), n_words, hit_spans, n_hit, items, contaminated.

    Words are the runs [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the whole text with A-Z lower-cased. A
    document word is hit if it lies in an occurrence of a window of a benchmark item; hit_spans are
    the maximal runs of hit words (first word, end exclusive), items the sorted ids (as strings) of
    items with occurring windows. contaminated: n_hit > 0 and 20 n_hit >= n_words. Null and empty
    texts have no words. Items without an id, without text or without words hit nothing; an item id on
    several rows is one item with all their windows. Repeated documents give as many rows; an empty
    benchmark hits nothing; an empty table gives no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    kept = tuple(f"`kept_{c}`" for c in keep)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).dropna()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BLOCK_BYTES:
        hits = _against(docs.withColumnRenamed("doc_id", "uid"), [tuple(r) for r in bench.collect()], kept).withColumnRenamed("uid", "doc_id")
    else:
        docs = written(docs.withColumn("uid", F.monotonically_increasing_id()), "documents")
        hits = _joined(docs, bench).join(docs.select("uid", "doc_id", *kept), "uid")
    spans, n_hit = F.col("spans"), F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")
    return hits.select(
        "doc_id", *kept, "n_words", spans.alias("hit_spans"), n_hit.alias("n_hit"), F.array_sort("items").alias("items")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
