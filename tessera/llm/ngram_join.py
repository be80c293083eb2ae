"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two sets of sizes m and n with a Jaccard similarity of 3/4 or more share at least
T = ceil(3 (m + n) / 7) shingles. DivideSkip splits a query's inverted lists into the long ones,
which are only probed by binary search, and the short ones, which are merged: a document that
reaches T over all lists occurs in the short ones. Here that is done twice.

Over the corpus: a set's shingles are ordered by (corpus frequency if frequent, hash); its
n - ceil(3n/4) + 1 first ones are its short lists, since two sets that are similar share one of
them. Lists are dealt by shingle. Lists of up to LONG_LIST sets are merged at once into counts of
shared shingles for each pair, and a pair goes on only if count plus what the unmerged lists and
the rest of the sets could add reaches T. Longer lists (passages that many texts share, large
groups of near copies) are never merged into pairs: their sets are searched for those similar to one
hub, linked sets become one component, and only sets left outside their hub's component are queries,
against blocks of the hub's sets of about their size.

Candidates meet in groups: a query (a set, a hub, a block's sets) and the sets that may be similar to
it. DivideSkip searches each group: inverted lists over the whole sets, the query's short ones merged by
counting, long ones probed for what is left, and the exact test 7 * shared >= 3 * (m + n).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitfilter import id_bits, with_bit
from .components import components
from .runtime import discard, partitions, prepare, sliced, written
from .text_kernel import mix, text_sets

#: Words in a shingle.
WORDS = 5
#: Size of the table of frequent shingles; it only orders shingles, results don't depend on it.
FREQUENT = 1 << 20
#: Shingles among which a task counts at a time, and the count from which it reports one.
COUNTED, REPORTED = 2_000_000, 2
#: Postings that a task packs at a time, and fingerprints by which it knows copies.
PACKED, KNOWN = 1_000_000, 200_000
#: Sets in an inverted list up to which it is merged into pairs, and texts from which a list isn't gathered in one task at all.
LONG_LIST, HOT = 64, 4_096
#: Queries of a group, other sets of a group, and shingles that are indexed at a time.
BLOCK, QUERIES, INDEXED = 256, 2_048, 1 << 20
#: Groups in which the members of a component, or of a long list, are told what holds for all.
SALTS = 64


def needed(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shared shingles that sets of m and n need."""
    return -(-3 * (m + n) // 7)


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """64 bits of a set."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (doc_id, set size, fingerprint). Kind 1: (shingle, count) of what is frequent in a stretch of texts."""
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= REPORTED
        values, counts = values[keep], counts[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(values), np.int8)), pa.array(signed(values)), pa.array(counts), pa.array(np.zeros(len(values), np.int64))],
            ["kind", "id", "n", "fp"],
        )

    for batch in batches:
        ns, fps = [], []
        for s in text_sets(batch.column(1)):
            ns.append(len(s))
            fps.append(fingerprint(s))
            if len(s):
                held.append(s)
                size += len(s)
            if size >= COUNTED:
                yield from sliced(frequent())
                held, size = [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(ns), np.int8)), batch.column(0), pa.array(np.array(ns, np.int64)), pa.array(signed(np.array(fps, np.uint64)))],
            ["kind", "id", "n", "fp"],
        )
    if held:
        yield from sliced(frequent())


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles, at most FREQUENT, of the highest counts, and their counts."""
    counted = written(counted, "counts")
    size, least = 0, None
    for r in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        size += r.k
        if size > FREQUENT:
            break
        least = r.n
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    top = counted.where(F.col("n") >= least).toArrow()
    known, counts = top["id"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


def _lists(table, buckets: int):
    """Deals the short lists' postings by shingle, one row for each bucket and stretch of texts, packed; those of shingles of HOT texts by set, to as many buckets more."""

    def rank(s: np.ndarray) -> np.ndarray:
        known, counts = table.value
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        return np.where(known[at] == s, counts[at], 0) if len(known) else np.zeros(len(s), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks: list[np.ndarray] = []
        hot: list[np.ndarray] = []
        sets: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        size = 0

        def packed() -> pa.RecordBatch:
            tok, far = np.concatenate(toks), np.concatenate(hot)
            node = np.repeat(np.array([s[0] for s in sets], np.uint64), [s[2] for s in sets])
            n = np.repeat(np.array([s[1] for s in sets], np.uint32), [s[2] for s in sets])
            bucket = np.where(far, mix(node) % np.uint64(buckets) + np.uint64(buckets), mix(tok) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tok, node, n, bucket = tok[order], node[order], n[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows = [tok[a:b].tobytes() + node[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(rows, pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for s in text_sets(batch.column(0)):
                n = len(s)
                if not n:
                    continue
                fp = int(fingerprint(s))
                if fp in seen:  # an exact copy's lists are the same
                    continue
                if len(seen) < KNOWN:
                    seen.add(fp)
                own = n - -(-3 * n // 4) + 1
                often = rank(s)
                first = np.argsort(often, kind="stable")[:own] if often.any() else slice(own)
                toks.append(s[first])
                hot.append(often[first] > HOT)
                sets.append((fp, n, own))
                size += own
                if size >= PACKED:
                    yield from sliced(packed(), 16)
                    toks, hot, sets, size = [], [], [], 0
        if toks:
            yield from sliced(packed(), 16)

    return run


def _unpacked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, set, size of the set) of packed postings."""
    size = [len(x) // 20 for x in raw]
    tok = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(raw, size, strict=True)])
    node = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(raw, size, strict=True)])
    n = np.concatenate([np.frombuffer(x, np.uint32, n, 16 * n) for x, n in zip(raw, size, strict=True)]).astype(np.int64)
    return tok, node, n


def _long(tok: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(tok), 1 << 16):
        at = slice(a, a + (1 << 16))
        yield _rows(1, signed(tok[at]), node[at], np.ones(len(tok[at]), np.int64), n[at], n[at])


def _merged_lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = []
        for batch in batches:
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < buckets:
                    raw.append(x)
                else:  # never gathered
                    tok, node, n = _unpacked([x])
                    yield from _long(tok, signed(node), n)
        yield from _merge(raw)

    return run


def _merge(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Short lists into (kind 0: a < b, shared, sizes); long lists as they are (kind 1: shingle, set, -, size)."""
    if not raw:
        return
    tok, node, n = _unpacked(raw)
    raw.clear()
    order = np.lexsort((signed(node), tok))
    tok, node, n = tok[order], signed(node[order]), n[order]
    fresh = np.concatenate([[True], (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])])  # copies met in other tasks
    tok, node, n = tok[fresh], node[fresh], n[fresh]
    cuts = np.concatenate([[0], np.flatnonzero(tok[1:] != tok[:-1]) + 1, [len(tok)]])
    length = np.diff(cuts)
    long = np.repeat(length > LONG_LIST, length)
    yield from _long(tok[long], node[long], n[long])
    #: Pairs at a distance d in their list, for every d: all of them once, without a loop over lists.
    short = np.repeat(length <= LONG_LIST, length) & np.repeat(length > 1, length)
    tok, node, n = tok[short], node[short], n[short]
    found: list[np.ndarray] = []
    for d in range(1, LONG_LIST):
        same = np.flatnonzero(tok[d:] == tok[:-d])
        if not len(same):
            break
        m, k = n[same], n[same + d]
        same = same[4 * np.minimum(m, k) >= 3 * np.maximum(m, k)]
        found.append(np.stack([node[same], node[same + d], n[same], n[same + d]]))
    if found:
        pairs = np.concatenate(found, axis=1)
        order = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, order]
        cuts = np.concatenate([[0], np.flatnonzero((pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])) + 1, [pairs.shape[1]]])
        shared, pairs = np.diff(cuts), pairs[:, cuts[:-1]]
        for a in range(0, pairs.shape[1], 1 << 16):
            p = pairs[:, a : a + (1 << 16)]
            yield _rows(0, p[0], p[1], shared[a : a + (1 << 16)], p[2], p[3])


def _rows(kind: int, a: np.ndarray, b: np.ndarray, shared: np.ndarray, m: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *map(pa.array, (a, b, shared, m, n))], ["kind", "a", "b", "shared", "m", "n"])


def divide_skip(index: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each query set, the positions of the index sets whose Jaccard similarity with it is 3/4 or more.

    Sets are sorted arrays without repeats; empty sets are similar to none.
    """
    sizes = np.array([len(s) for s in index], np.int64)
    if not len(index) or not sizes.sum():
        yield from (np.empty(0, np.int64) for _ in queries)
        return
    tok = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(tok, kind="stable")
    tok, owner = tok[order], owner[order]
    for q in queries:
        lo, hi = np.searchsorted(tok, q, "left"), np.searchsorted(tok, q, "right")
        length = hi - lo
        least = -(-3 * len(q) // 4)  # T for the smallest set that can be similar
        if not len(q) or np.count_nonzero(length) < least:
            yield np.empty(0, np.int64)
            continue
        by = np.argsort(length, kind="stable")
        skipped = min(least - 1, int(least / (0.1 * math.log(max(2, int(length.max()))) + 1)))
        short, long = by[: len(q) - skipped], by[len(q) - skipped :]
        runs = length[short]
        total = int(runs.sum())
        at = np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(lo[short], runs)
        count = np.bincount(owner[at], minlength=len(index))
        t = needed(np.int64(len(q)), sizes)
        near = np.flatnonzero((count >= t - skipped) & (count > 0) & (4 * np.minimum(sizes, len(q)) >= 3 * np.maximum(sizes, len(q))))
        if len(near):
            hits = np.zeros(len(near), np.int64)
            for k in long:  # owners within a list are sorted
                own = owner[lo[k] : hi[k]]
                at = np.searchsorted(own, near)
                hits += (at < len(own)) & (own[np.minimum(at, max(0, len(own) - 1))] == near) if len(own) else 0
            near = near[count[near] + hits >= t[near]]
        yield near


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between each group's queries (role 0), which come first, and its other sets (role 1), which are indexed a stretch at a time."""
    group, asked, who, seen = None, [], [], set()
    for batch in batches:
        node, role = batch.column("node").to_numpy(), batch.column("role").to_numpy()
        keys = list(zip(batch.column("g1").to_pylist(), batch.column("g2").to_pylist(), batch.column("g3").to_pylist(), strict=True))
        a, b = [], []
        index: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0

        def answer() -> None:
            for q, near in zip(who, divide_skip(index, asked) if index else (), strict=False):
                for i in near:
                    if nodes[i] != q:
                        a.append(q)
                        b.append(nodes[i])
            index.clear()
            nodes.clear()

        for i, s in enumerate(text_sets(batch.column("text"), WORDS)):
            if keys[i] != group:
                answer()
                group, asked, who, seen, size = keys[i], [], [], set(), 0
            # where ids repeat, a node's id can bring other texts along, and equal rows bring a text twice
            me = (int(node[i]), int(role[i]))
            if me in seen or not len(s) or fingerprint(s).view(np.int64) != node[i]:
                continue
            seen.add(me)
            if role[i]:
                index.append(s)
                nodes.append(me[0])
                size += len(s)
                if size >= INDEXED:
                    answer()
                    size = 0
            else:
                asked.append(s)
                who.append(me[0])
        answer()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _searched(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """groups(g1, g2, g3, role, node): links between queries (role 0) and the other sets (role 1) of a group."""
    parts = partitions(groups.sparkSession)
    rows = groups.join(texts, "node").repartition(parts, "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "role")
    return rows.mapInArrow(_search, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, doc_id)."""
    return with_bit(docs, id_bits(wanted), True).join(wanted, "doc_id").select("node", "text")


def _group(df: DataFrame, g2, g3, role: int, node: str) -> DataFrame:
    return df.select(F.col("a").alias("g1"), g2.cast("long").alias("g2"), g3.cast("long").alias("g3"), F.lit(role).alias("role"), F.col(node).alias("node"))


def _tested(pairs: DataFrame) -> DataFrame:
    """Distinct pairs(a, b) as groups: a asks its b's, of which QUERIES or so are a group."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
    salted = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")))
    asks = _group(salted.select("a", "salt").distinct(), F.col("salt"), F.lit(0), 0, "a")
    return asks.union(_group(salted, F.col("salt"), F.lit(0), 1, "b"))


def _hubs(long: DataFrame) -> DataFrame:
    """long(tok, node, n) -> (a, b, n): each set of a list beside the list's hub, its least set. A list meets in SALTS groups, then these."""
    salted = long.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    some = salted.groupBy("tok", "salt").agg(F.min("node").alias("least"))
    hubs = some.groupBy("tok").agg(F.min("least").alias("a"))
    spread = some.select("tok", "salt").join(hubs, "tok")
    return salted.join(spread, ["tok", "salt"]).select("a", F.col("node").alias("b"), "n").distinct()


def _outside(spokes: DataFrame, out: DataFrame, n: int) -> DataFrame:
    """spokes(a, b, n), and those of them (out) that aren't linked with their hub, as groups: each of these meets all sets of its
    hub's list whose size lets them be similar. Lists are cut by size and into blocks of a bounded number of shingles."""
    kind = F.floor(F.log(F.col("n")) / math.log(1.34)).cast("long")  # similar sets are of one kind, or of neighbouring ones
    held = spokes.join(out.select("a").distinct(), "a", "left_semi").withColumn("kind", kind)
    asks = out.withColumn("kind", F.explode(F.array(kind - 1, kind, kind + 1)))
    blocks = held.groupBy("a", "kind").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / INDEXED)).alias("blocks"))
    parts = asks.groupBy("a", "kind").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    sizes = written(blocks.join(parts, ["a", "kind"]), "sizes", n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda c: F.col("kind") * 1_000_000_000 + F.col(c)
    held = held.join(sizes, ["a", "kind"]).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks"))).withColumn("part", every("parts"))
    asks = asks.join(sizes, ["a", "kind"]).withColumn("part", F.pmod(F.xxhash64("b", F.lit(1)), F.col("parts"))).withColumn("block", every("blocks"))
    return _group(held, place("block"), F.col("part"), 0, "b").union(_group(asks, place("block"), F.col("part"), 1, "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds the distinct runs of five words of its whole text (A-Z lower-cased, words
    without ASCII white space); with fewer words, the whole sequence is its one element. Two documents
    link when their sets' Jaccard similarity is 0.75 or more; component_id is the smallest id that
    links reach, the own one included. Null or wordless text: n_shingles 0, linked with nothing. Equal
    texts link. Rows that repeat an id give as many rows. An empty table gives none. Other columns are
    ignored; rows without an id can't be linked and come out with a null component_id.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = written(docs.mapInArrow(_measure, "kind byte, id long, n long, fp long"), "sets")
    members = measured.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "fp")
    known, counts = _frequent(measured.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")))

    parts = partitions(spark)
    dealt = docs.select("text").mapInArrow(_lists(spark.sparkContext.broadcast((known, counts)), 4 * parts), "bucket long, packed binary")
    merged = written(dealt.repartition(parts, "bucket").mapInArrow(_merged_lists(4 * parts), "kind byte, a long, b long, shared long, m long, n long"), "lists")
    long = merged.where("kind = 1").select(F.col("a").alias("tok"), F.col("b").alias("node"), "n")
    n_long = long.count()
    any_long = n_long > 0

    pairs = merged.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("m").alias("m"), F.max("n").alias("n"))
    # what the shingles beyond the short lists can add: the set whose last short list comes first has ceil(3n/4) - 1 of them
    rest = F.ceil(3 * F.greatest("m", "n") / 4) - 1
    lack = F.ceil(3 * (F.col("m") + F.col("n")) / 7) - F.col("shared") - rest
    pairs = measured_pairs = written(pairs.select("a", "b", lack.alias("lack")), "pairs")
    enough = pairs.where("lack <= 0").select("a", "b")
    if any_long:  # lists that weren't merged may add what lacks, where both sets have some
        for side in ("a", "b"):
            pairs = pairs.join(long.groupBy(F.col("node").alias(side)).agg(F.count("*").alias(f"more_{side}")), side)
        enough = enough.union(pairs.where("lack > 0 and lack <= least(more_a, more_b)").select("a", "b"))
    pairs = enough

    reps = members.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))
    if any_long:
        wanted = wanted.union(long.select("node"))
    wanted = reps.join(wanted.distinct(), "fp", "left_semi").select(F.col("fp").alias("node"), "doc_id")
    texts = written(_texts(docs, wanted), "texts")
    if any_long:
        spokes = written(_hubs(long), "spokes", n_long)
        n_asked = measured_pairs.count() + n_long
        asked = written(pairs.union(spokes.where("a <> b").select("a", "b")).distinct(), "asked", n_asked)
        links = written(_searched(_tested(asked), texts), "links")
        roots = components(links)
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        placed = spokes.join(root("a"), "a", "left").join(root("b"), "b", "left")
        out = written(placed.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b", "n"), "outside", n_long)
        if not out.isEmpty():
            more = written(_searched(_outside(spokes, out, n_long), texts), "links")
            discard(roots)
            roots = components(links.union(more))
            discard(more)
        discard(links, spokes, asked, out)
    else:
        asked = written(pairs.distinct(), "asked", measured_pairs.count())
        roots = components(_searched(_tested(asked), texts))
        discard(asked)
    discard(merged, measured_pairs, texts)
    return members.join(_named(reps, roots), "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _named(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """reps(fp, doc_id), roots(node, root) -> (fp, component_id). A component's members meet in SALTS groups, then these."""
    linked = reps.join(roots, reps["fp"] == roots["node"]).select("fp", "root", "doc_id", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    some = linked.groupBy("root", "salt").agg(F.min("doc_id").alias("least"))
    least = some.groupBy("root").agg(F.min("least").alias("component_id"))
    spread = some.select("root", "salt").join(least, "root")
    found = linked.join(spread, ["root", "salt"]).select("fp", "component_id")
    return reps.join(found, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
