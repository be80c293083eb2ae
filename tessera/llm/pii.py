"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

The base kinds (email, ip, card, phone) are found by form. They are the seeds: the words around their
occurrences are lexical patterns, and every identifier-like token of the corpus is an instance, so
patterns and instances form a bipartite graph. Spark scores it iteratively: a pattern's confidence for a
kind is the lower end of the 95 % interval of the share of its instances (each weighed by its own
confidence, seeds 1) that are of the kind, without those still open (unknown, of a form that the kind
may have); an instance's is the highest among its patterns'. Patterns of high confidence then mark
identifiers that the base forms miss, where a token's own form allows the kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, fresh, prepare, written

KINDS = ("email", "ip", "card", "phone")
#: Confidence from which a pattern or an instance counts as known, and the rounds of scoring.
CONFIDENT, ROUNDS = 0.9, 3
#: Distinct instances that a pattern comes with at least, whatever the corpus's size; patterns that are held in memory at a time.
LEAST, HELD = 20, 100_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Identifier-like tokens that aren't base matches, of which digit groups with single spaces between are one: a form that a kind may have.
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_GROUPS = re.compile(r"[0-9().\-/]+\Z")
_FORMS = (
    ("email", re.compile(r"[\w.%+-]+(?:@|\(at\)|\[at\])[\w-]+(?:(?:\.|\(dot\)|\[dot\])[\w-]+)*\Z")),
    ("ip", re.compile(r"(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\Z|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+|/[0-9]+)\Z")),
    ("card", re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?\Z|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}\Z")),
    ("phone", re.compile(r"(?=\S+ )(?=(?:[ ().\-/]*+[0-9]){7,15}+[ ().\-/]*+\Z)\(?[0-9]{1,5}\)?(?:(?:[-./ ]|(?<=\)))\(?[0-9]{2,5}\)?){1,6}\Z")),
    ("phone", re.compile(r"\(?[0-9]{2,4}\)?(?:[-./][0-9]{2,5}){1,4}\Z|00?[0-9]{8,13}\Z")),
    ("card", re.compile(r"[0-9]{13,19}\Z|[0-9]{4}(?:-[0-9]{4}){2,3}\Z")),
)
_TRIM = " \t\n.,;:!?\"'<>*#%&$|[]{}"


def _octet(part: str) -> bool:
    """Whether the digits, with any number of zeros before, are at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches, from one @ to the next: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(_LOCAL))
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1  # no local part goes beyond an @
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _context(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, within 80 characters before and 40 after it: the word before it, the two before it, the words at both sides."""
    left = [w.strip(_TRIM).lower() for w in text[max(0, start - 80) : start].split()[-2:]]
    right = [w.strip(_TRIM).lower() for w in text[end : end + 40].split()[:1]]
    left = [w for w in left if w and not _DIGIT.search(w)]
    out = []
    if left:
        out.append(f"{left[-1]} _")
        if len(left) == 2:
            out.append(f"{left[0]} {left[1]} _")
        if right and right[0] and not _DIGIT.search(right[0]):
            out.append(f"{left[-1]} _ {right[0]}")
    return out


def _others(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Identifier-like tokens outside the base spans, with the kind that their form allows ('' for none).

    Digit groups (with dots, hyphens, slashes and parentheses) that single spaces join are one token, as many as there are.
    """
    if not _DIGIT.search(text) and "@" not in text:
        return
    taken = sorted((a, b) for _, a, b in spans)
    i = 0
    held = None  # start, end, whether of digit groups, how many
    for m in _TOKEN.finditer(text):
        if not _MARK.search(m[0]) or not (word := m[0].strip(_TRIM)):
            continue
        a = m.start() + m[0].index(word)
        b = a + len(word)
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        groups = bool(_GROUPS.match(word))
        if held and held[2] and groups and a == held[1] + 1 and text[held[1]] == " ":
            held = (held[0], b, True, held[3] + 1)
            continue
        if held:
            yield _formed(text, *held)
        held = (a, b, groups, 1)
    if held:
        yield _formed(text, *held)


def _formed(text: str, a: int, b: int, groups: bool, n: int) -> tuple[str, int, int]:
    if n > 1:  # parentheses around all of it aren't part of it
        word = text[a:b]
        if word[0] == "(" and ")" not in word[:-1]:
            a += 1
        if word[-1] == ")" and "(" not in text[a:b]:
            b -= 1
    return next((k for k, form in _FORMS if form.match(text[a:b])), ""), a, b


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, instance, kind of a seed or '', form's kind or '') for each identifier-like token and pattern around it."""
    for batch in batches:
        pattern, instance, kind, form = [], [], [], []
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            for k, f, a, b in [*((k, "", a, b) for k, a, b in spans), *(("", f, a, b) for f, a, b in _others(text, spans))]:
                name = text[a:b].lower()
                name = name if len(name) <= 320 else hashlib.sha256(name.encode()).hexdigest()
                for p in _context(text, a, b):
                    pattern.append(p)
                    instance.append(name)
                    kind.append(k)
                    form.append(f)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (pattern, instance, kind, form)], ["pattern", "instance", "kind", "form"])


def learn_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, kind, confidence) of the patterns that the corpus supports; see the module's text.

    The pattern-instance graph holds one edge for each distinct pair, so copies of a text count once.
    """
    prepare(docs.sparkSession)
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(_occurrences, "pattern string, instance string, kind string, form string")
    found = written(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("form").alias("form")), "occurrences")
    strong = found.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    edges = found.join(strong, "pattern")
    known = edges.where("kind <> ''").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    patterns = None
    others = edges.where("kind = ''").drop("kind").withColumnRenamed("form", "kind")
    for _ in range(ROUNDS):
        before = (patterns, known)
        share = edges.drop("kind", "form").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("s"), F.first("n").alias("all"))
        still = others.join(known, ["instance", "kind"], "left_anti").groupBy("pattern", "kind").agg(F.count("*").alias("open"))
        share = share.join(still, ["pattern", "kind"], "left").withColumn("n", F.col("all") - F.coalesce("open", F.lit(0))).where(F.col("s") >= LEAST)
        p, z = F.least(F.col("s") / F.col("n"), F.lit(1.0)), 1.96
        low = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
        patterns = written(share.withColumn("confidence", low).where(F.col("confidence") >= CONFIDENT).select("pattern", "kind", "confidence"), "patterns")
        new = others.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
        known = written(known.where("belief = 1.0").union(new.select("instance", "kind", "belief")).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "known")
        discard(*before)
    discard(found, known)
    return patterns


def all_spans(text: str, patterns: dict[str, dict[str, float]]) -> tuple[list, list]:
    """Base spans, and spans that patterns add, each by kind, then start."""
    base = base_spans(text)
    more = []
    if patterns:
        for kind, a, b in _others(text, base):
            if kind and any(kind in patterns.get(p, ()) for p in _context(text, a, b)):
                more.append((kind, a, b))
        more.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return base, more


def _held(patterns: DataFrame) -> Iterator[dict[str, dict[str, float]]]:
    """The patterns in blocks of about HELD by their hash, one at least."""
    blocks = max(1, -(-patterns.count() // HELD))
    for k in range(blocks):
        out: dict[str, dict[str, float]] = {}
        for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect():
            out.setdefault(r.pattern, {})[r.kind] = r.confidence
        yield out


_ADDED = "array<struct<kind:string,start:int,end:int>>"


def _with_added(rows: DataFrame, text_col: str, patterns: DataFrame) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """rows with one more last column, the spans that all but the last block of patterns add, and the last block.

    With more than one block the rows are written after each: a span is added if any of its patterns is known.
    """
    rows = rows.withColumn(fresh("added", rows.columns), F.array().cast(_ADDED))
    at, schema, held = rows.columns.index(text_col), rows.schema, None
    for block in _held(patterns):
        if held is not None:
            known = rows.sparkSession.sparkContext.broadcast(held)

            def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    columns = list(batch.columns)
                    added = [_merged(old, all_spans(t or "", known.value)[1]) for t, old in zip(columns[at].to_pylist(), columns[-1].to_pylist(), strict=True)]
                    columns[-1] = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in a] for a in added], columns[-1].type)
                    yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

            before, rows = rows, written(rows.mapInArrow(run, schema), "added")
            discard(before)
        held = block
    return rows, held


def _merged(old: list[dict], new: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted({*((s["kind"], s["start"], s["end"]) for s in old), *new}, key=lambda s: (KINDS.index(s[0]), s[1]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, base>>, by kind, then start.

    Places are code points of the whole text, end exclusive. Base spans are the leftmost non-overlapping
    matches of each kind that pass its test; spans of different kinds may overlap. Added spans don't touch
    base spans. Null and empty texts have no spans; repeated rows give as many rows; an empty table none.
    Other columns are ignored. patterns: learn_patterns' result, learned from the documents by default.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, last = _with_added(rows, "text", learn_patterns(docs, text_col) if patterns is None else patterns)
    known = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base, more = all_spans(text or "", known.value)
                more = _merged(added, more)
                spans = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in more]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def masked(text: str, patterns: dict[str, dict[str, float]], added: list[dict] = ()) -> str:
    """The text with every span, and those added before, replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    base, more = all_spans(text, patterns)
    more = _merged(added, more)
    if not base and not more:
        return text
    out, done = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in base + more):
        b = -b
        if a >= done:
            out += [text[done:a], f"<{k.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text_col: str = "text", patterns: DataFrame | None = None) -> DataFrame:
    """The documents, all columns, with personal data in the text masked. Null texts stay null."""
    prepare(docs.sparkSession)
    rows, last = _with_added(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, learn_patterns(docs, text_col) if patterns is None else patterns)
    known = docs.sparkSession.sparkContext.broadcast(last)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, added = batch.columns
            texts = zip(columns[at].to_pylist(), added.to_pylist(), strict=True)
            columns[at] = pa.array([t and masked(t, known.value, a) for t, a in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)
