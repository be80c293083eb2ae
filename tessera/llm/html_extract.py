"""Main text of web pages: page structure, and a suffix array over each host's token streams.

Every page goes through its host's suffix array: the token streams of the host's pages are concatenated;
substrings of RUN tokens that repeat on several distinct pages, outside what is text for certain, are
boilerplate. Each block is judged by what they cover of it; then page structure checks the verdict. What
lies in an article (or main) element is the text, whatever of it the host repeats (n_repeated tells how many
words), and the parts that are never text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) go, though they be unique. Elsewhere the verdict holds. On pages without
an article, blocks and runs that are covered go and unique runs stay; within an article, blocks whose class
or id name may but needn't mean such a part ("related-work", "discussion") go if they are covered. Large
hosts have several arrays, whose counts of pages are added up run by run.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, partitions, prepare, sliced, written

#: Tokens of a repeated substring; distinct pages that it must occur on, and no share of the host's, which would grow with it.
RUN, PAGES, PAGE_SHARE = 8, 3, 0
#: Pages of a host whose streams share one suffix array; larger hosts have several.
HOST_PAGES = 512

_RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav footer aside form menu dialog noscript object embed select button datalist audio video canvas map head applet input label".split())
_NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of class and id names of parts that aren't text.
_NEVER_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidenav menu nav navbar navigation topnav "
    "breadcrumb breadcrumbs footer colophon cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup "
    "login share sharing related recommended recommendations comments comment commentlist disqus respond replies reply toolbar pagination pager paywall alert skip".split()
)
#: Words that name such parts and text alike.
_UNSURE_NAME = frozenset("discussion feedback disclaimer social widget rail".split())
#: Words that stand beside them in names of the same parts.
_PART_NAME = frozenset(
    "area bar block body bottom box btn button buttons card cards center column container content count div entries fixed form google grid group header heading holder icon icons inline inner "
    "item items label large left link links list main message mobile module more news outer page panel place placeholder post posts primary reader readers right row section secondary "
    "side site slot small sticky stories tag tags teaser teasers text thread title to top unit user users view vertical wrap wrapper zone".split()
)
#: Of these, names that layouts give to whole pages too ("with-sidebar"): an article inside is one all the same.
_LAYOUT_NAME = frozenset("banner sidebar sidenav menu nav navbar navigation topnav footer overlay modal cookie cookies notice alert ad ads".split())
#: Class and id names that make an element the article of a page without an article or main element.
_ARTICLE_NAME = re.compile(r"(?<![a-z0-9])(?:article[-_]?(?:body|content|text)|post[-_]?(?:body|content|text)|entry[-_]?(?:body|content|text)|story[-_]?(?:body|content|text)|main[-_]?(?:content|text)|page[-_]?content)(?![a-z0-9])")
_HEAD_NAME = frozenset("header masthead topbar".split())
#: Elements that end an open one of the key.
_CLOSED_BY = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>|<[!?/][^>]*>|[^<]+|<""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:@-][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in _RAW}

#: Roles of blocks: text, never text, undecided on a page without an article, undecided within the article.
TEXT, NEVER, OPEN, UNSURE = 0, 1, 2, 3
#: How an element is ruled out: not at all, perhaps, by a name that layouts use too, for good.
NO, PERHAPS, LAYOUT, FOR_GOOD = 0, 1, 2, 3


class _Node:
    """An open element: the article it lies in, how it is ruled out and by which element, whether it lies in a link.

    void: a name that would rule out an inline element, which is never closed, rules out nothing.
    """

    __slots__ = ("article", "at", "block", "by", "link", "named", "never", "tag", "void")

    def __init__(self, tag: str, at: int, block: int, never: int, article: int, link: bool, by: _Node | None, named: bool):
        self.tag, self.never, self.article, self.link, self.named, self.void = tag, never, article, link, named, False
        self.at, self.block = at, at if tag in _BLOCK else block  # its place in the stack, and the innermost block's
        self.by = by or (self if never else None)

    def ruled(self) -> int:
        return self.never if self.by is None or not self.by.void else NO


_OUTSIDE = _Node("", -1, -1, NO, -1, False, None, False)


def _name_rules_out(name: str, in_article: bool) -> int:
    """What one class or id name says: it rules out if all its words name such a part, and perhaps if some do."""
    words = [w.lower() for w in _WORD.findall(name)]
    never = [w for w in words if w in _NEVER_NAME or (w in _HEAD_NAME and not in_article)]
    if not never:
        return PERHAPS if any(w in _UNSURE_NAME for w in words) else NO
    if not all(w in never or w in _PART_NAME or w in _UNSURE_NAME for w in words):
        return PERHAPS
    return LAYOUT if all(w in _LAYOUT_NAME or w in _HEAD_NAME for w in never) else FOR_GOOD


def _is_never(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """How an element is ruled out, and whether by its class or id name."""
    if tag in _NEVER or (tag == "header" and not in_article):
        return FOR_GOOD, False
    if not attrs:
        return NO, False
    found = NO
    title = tag in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6")
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if not title or "omment" in value:
                found = max(found, *(_name_rules_out(part, in_article) for part in value.split()), NO)
        elif name == "role" and value.lower() in _NEVER_ROLE and tag not in ("html", "body", "article", "main"):
            return FOR_GOOD, False
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return FOR_GOOD, False
    return found, True


def blocks(page: str, named: bool = False) -> tuple[list[tuple[str, int, int, bool]], list[tuple[int, bool]]]:
    """((text, article number or -1, how it is ruled out, mostly links) of each block in page order, articles).

    articles: (the one around it or -1, whether it is an article element). A block's pieces that inline
    elements rule out are a block of their own, after the rest of it. Linear in the page. named: elements
    named like an article count as one.
    """
    tokens = list(_scan(page))
    left: dict[str, int] = {}  # end tags still to come
    for kind, tag, _ in tokens:
        if kind == "end":
            left[tag] = left.get(tag, 0) + 1
    stack: list[_Node] = []
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    out: list[tuple[str, int, int, bool]] = []
    pieces: list[tuple[str, _Node]] = []  # of the block, each with the element around it
    articles: list[tuple[int, bool]] = []
    top = _OUTSIDE

    def flush() -> None:
        if not pieces:
            return
        kinds: dict[tuple[int, int], list[tuple[str, _Node]]] = {}
        for piece in pieces:
            kinds.setdefault((piece[1].article, piece[1].ruled()), []).append(piece)
        for (article, never), own in sorted(kinds.items(), key=lambda x: x[0][1]) if len(kinds) > 1 else kinds.items():
            joined = " ".join(html.unescape("".join(t for t, _ in own)).split())
            if joined:
                out.append((joined, article, never, sum(len(t) for t, node in own if node.link) > 0.6 * len(joined)))
        pieces.clear()

    def cut_off(i: int, ended: bool = False) -> None:
        """Closes the elements from place i on; ended: by an end tag of the first of them."""
        nonlocal top
        for node in stack[i + ended :]:
            node.void = node.named and node.tag not in _BLOCK and node.never != NO
        if pieces and any(node.tag in _BLOCK for node in stack[i:]):
            flush()
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]
        top = stack[-1] if stack else _OUTSIDE

    for kind, tag, attrs in tokens:
        if kind == "text":
            pieces.append((attrs, top))
        elif kind == "end":
            left[tag] -= 1
            if places.get(tag):
                cut_off(places[tag][-1], True)
            if tag in _BLOCK:
                flush()
        elif tag == "br":
            pieces.append((" ", top))
        else:
            if tag in _BLOCK:
                i = top.block  # formatting left open doesn't keep a paragraph open
                # nor does a part within it that goes on
                if i >= 0 and tag in _CLOSED_BY.get(stack[i].tag, ()) and (tag == "p" or not top.ruled() or top.by.at < i or not left.get(top.by.tag)):
                    cut_off(i)
                flush()
            if tag in _VOID:
                continue
            article, never, by = top.article, top.ruled(), top.by if top.ruled() else None
            opens = tag in ("article", "main") or 'role="main"' in attrs or (named and article < 0 and tag in _BLOCK and bool(_ARTICLE_NAME.search(attrs.lower())))
            if opens:
                flush()
            if opens and never:
                if not left.get(by.tag):
                    cut_off(by.at)  # a menu or advert that is never closed ends where the article begins
                    article, never, by = top.article, top.ruled(), top.by if top.ruled() else None
                elif never in (LAYOUT, PERHAPS):
                    never, by = NO, None
            named_so = False
            if never in (NO, PERHAPS):
                own, named_so = _is_never(tag, attrs, article >= 0)
                if own > never:
                    never, by = own, None
            if opens and never in (NO, PERHAPS) and (article < 0 or tag == "article"):
                articles.append((article, tag == "article"))
                article = len(articles) - 1
            places.setdefault(tag, []).append(len(stack))
            top = _Node(tag, len(stack), top.block, never, article, top.link or tag == "a", by, named_so)
            stack.append(top)
    flush()
    return out, articles


def _scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("start" | "end" | "text", tag, attributes or text); comments, declarations and raw elements left out."""
    at, n = 0, len(page)
    gone: set[str] = set()  # raw elements without an end from here on
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if tag:
            if m[1] or m[4]:
                yield "end", tag, ""
                continue
            attrs = m[3] or m[6] or ""
            if tag in _RAW and not attrs.endswith("/"):
                end = None if tag in gone else _END_RAW[tag].search(page, at)
                if end:
                    at = end.end()
                    continue
                gone.add(tag)
                if tag in ("script", "style"):
                    return
                continue
            yield "start", tag, attrs
        elif m[0][0] != "<" or len(m[0]) == 1:
            yield "text", "", m[0]


def _around(article: int, articles: list[tuple[int, bool]]) -> set[int]:
    out = set()
    while (article := articles[article][0]) >= 0:
        out.add(article)
    return out


def judged(page: str | None) -> tuple[list[str], list[int]]:
    """The page's blocks and what structure says of each: its role."""
    found, articles = blocks(page or "")
    if found and all(article < 0 for _, article, _, _ in found) and _ARTICLE_NAME.search((page or "").lower()):
        found, articles = blocks(page or "", named=True)
    size: dict[int, int] = {}
    teaser: dict[int, int] = {}
    for text, article, never, links in found:
        if article >= 0 and never in (NO, PERHAPS):
            size[article] = size.get(article, 0) + len(text)
            teaser[article] = teaser.get(article, 0) + len(text) * links
    if size:
        chosen = {a for a in size if articles[a][1]} or set(size)  # article elements before all else
        chosen = {a for a in chosen if 2 * teaser[a] <= size[a]} or chosen  # links to other pages aren't articles
        chosen -= {a for a in chosen if _around(a, articles) & chosen}  # an article within one is a comment on it
        role = lambda a, never, links: (TEXT if never == NO else UNSURE if never == PERHAPS else NEVER) if a in chosen else NEVER
    else:
        role = lambda a, never, links: OPEN if never in (NO, PERHAPS) and not links else NEVER
    return [t for t, *_ in found], [role(a, never, links) for _, a, never, links in found]


def parsed(page: str | None) -> tuple[str | None, list[str], list[int]]:
    """What structure makes of a page by itself: its text, and the blocks outside it with their roles; or None, and all its blocks, of which some are undecided."""
    texts, roles = judged(page)
    rows = list(zip(texts, roles, strict=True))
    if OPEN in roles or UNSURE in roles:
        return None, texts, roles
    rest = [(t, r) for t, r in rows if r != TEXT]
    return "\n".join(t for t, r in rows if r == TEXT), [t for t, _ in rest], [r for _, r in rest]


def _suffixes(distinct: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The suffix array of the streams to RUN tokens, built by prefix doubling.

    Each stream's begin, each place's page, the places in order, where a new run begins in it, and where a
    new page of a run does. Suffixes with one rank start with the same RUN tokens.
    """
    lengths = np.array([len(s) for s in distinct], np.int64)
    page = np.repeat(np.arange(len(distinct)), lengths + RUN)
    begin = np.cumsum(lengths + RUN) - (lengths + RUN)
    rank = -1 - np.arange(len(page), dtype=np.int64)  # what follows a page differs from everything
    for s, b in zip(distinct, begin, strict=True):
        rank[b : b + len(s)] = s
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < RUN:
        second = np.concatenate([rank[step:], np.arange(step) + len(page)])
        rank = np.unique(rank * (2 * len(page) + 1) + second, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.lexsort((page, rank))  # the suffix array
    r, p = rank[order], page[order]
    new_rank = np.concatenate([[True], r[1:] != r[:-1]])
    return begin, page, order, new_rank, new_rank | np.concatenate([[True], p[1:] != p[:-1]])


def repeated(streams: list[np.ndarray], more: list[np.ndarray] | tuple = ()) -> list[np.ndarray]:
    """For each page's token stream (token 0 ends a block), which tokens lie in boilerplate of the pages together; then the same of more streams.

    Streams that are equal count as one page, more streams as none.
    """
    kinds: dict[tuple[bool, bytes], int] = {}
    every = [*streams, *more]
    which = [kinds.setdefault((k < len(streams), s.tobytes()), len(kinds)) for k, s in enumerate(every)]
    distinct = list({k: s for k, s in zip(which, every, strict=True)}.values())
    if not distinct:
        return []
    begin, page, order, new_rank, new_page = _suffixes(distinct)
    covered = np.zeros(len(page) + 1, np.int64)
    counts = np.array([count for count, _ in kinds])
    pages = np.add.reduceat((new_page & counts[page[order]]).astype(np.int64), np.flatnonzero(new_rank))
    starts = order[pages[np.cumsum(new_rank) - 1] >= PAGES]
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + RUN, len(page)), -1)
    flags = np.cumsum(covered)[:-1] > 0
    return [flags[begin[k] : begin[k] + len(s)] for k, s in zip(which, every, strict=True)]


def _run_hashes(stream: np.ndarray) -> np.ndarray:
    """A hash of the RUN tokens from each place that has as many."""
    h = np.zeros(max(0, len(stream) - RUN + 1), np.uint64)
    for k in range(RUN if len(h) else 0):
        h = (h ^ stream[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def run_counts(streams: list[np.ndarray], counts: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of different streams, and of how many that count it is part."""
    if not streams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, page, order, new_rank, new_page = _suffixes(streams)
    first = np.flatnonzero(new_rank)
    pages = np.add.reduceat((new_page & np.array(counts)[page[order]]).astype(np.int64), first)
    hashes, whole = np.zeros(len(page), np.int64), np.zeros(len(page), bool)
    for s, b in zip(streams, begin, strict=True):
        h = _run_hashes(s)
        hashes[b : b + len(h)], whole[b : b + len(h)] = h, True
    inside = whole[order[first]]  # a run beyond its page's end is that page's alone
    return hashes[order[first]][inside], pages[inside]


def marked(stream: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which tokens of a stream lie in the runs (sorted hashes)."""
    covered = np.zeros(len(stream) + 1, np.int64)
    h = _run_hashes(stream)
    if len(runs) and len(h):
        starts = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, h), len(runs) - 1)] == h)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + RUN, -1)
    return np.cumsum(covered)[:-1] > 0


def _streams(texts: list[list[str]]) -> list[np.ndarray]:
    """Each page's tokens, the same number for a word on every page; 0 ends a block."""
    ids: dict[str, int] = {}
    out = []
    for own in texts:
        stream: list[int] = []
        for t in own:
            for w in t.split():
                if w not in ids:
                    ids[w] = (int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) >> 2) + 1
                stream.append(ids[w])
            stream.append(0)
        out.append(np.array(stream, np.int64))
    return out


def unique_runs(texts: list[list[str]], roles: list[list[int]], runs: np.ndarray | None = None) -> list[tuple[str, int]]:
    """Each page's text, and how many of its words the host repeats: the array's verdict on every block, checked by its role.

    runs: the host's repeated runs; None: what repeats on the pages together, outside text. A block that repeats
    cover to four fifths goes, unless it is text for certain; of other open blocks the unique runs stay, and of
    undecided blocks within an article all stays.
    """
    pages = list(zip(texts, roles, strict=True))
    outside = _streams([[t for t, k in zip(own, kind, strict=True) if k != TEXT] for own, kind in pages])
    inside = _streams([[t for t, k in zip(own, kind, strict=True) if k == TEXT] for own, kind in pages])
    covered = repeated(outside, inside) if runs is None else [marked(s, runs) for s in (*outside, *inside)]
    out = []
    for page, (own, kind) in enumerate(pages):
        kept, repeats = [], 0
        flags = {True: covered[len(pages) + page], False: covered[page]}  # by whether a block is text for certain
        at = {True: 0, False: 0}
        for t, k in zip(own, kind, strict=True):
            words, text = t.split(), k == TEXT
            gone = flags[text][at[text] : at[text] + len(words)]
            at[text] += len(words) + 1
            n = int(gone.sum())
            if not text and (k == NEVER or n >= 0.8 * len(words)):
                continue
            if n and k == OPEN:
                t, n = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g), 0
            kept.append(t)
            repeats += n
        out.append(("\n".join(kept), repeats))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the blocks and their roles in place of the last column, the page."""
    for batch in batches:
        rows = [judged(h) for h in batch.columns[-1].to_pylist()]
        columns = [pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))]
        yield from sliced(pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "blocks", "roles"]), 256)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict], list[dict]]]:
    """Of rows in order of (host, part, kind), each part's first row, its rows of kind 0 and its pages."""
    group, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["host"], r["part"]) != group:
                if held:
                    yield held[0], [x for x in held if not x["kind"]], [x for x in held if x["kind"]]
                group, held = (r["host"], r["part"]), []
            held.append(r)
    if held:
        yield held[0], [x for x in held if not x["kind"]], [x for x in held if x["kind"]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, run, pages) of the runs in each part; rows of kind 0 have the digests of the pages that count there."""
    for first, own, pages in _parts(batches):
        counts = {r["digest"] for r in own}
        distinct = {r["digest"]: [t for t, k in zip(r["blocks"], r["roles"], strict=True) if k != TEXT] for r in pages}
        runs, n = run_counts(_streams(list(distinct.values())), [d in counts for d in distinct])
        columns = [pa.array([first["host"]] * len(runs), pa.string()), pa.array([first["part"]] * len(runs), pa.int64()), pa.array(runs), pa.array(n)]
        yield from sliced(pa.RecordBatch.from_arrays(columns, ["host", "part", "run", "pages"]))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each part's pages; rows of kind 0 have the host's repeated runs, if it has several parts."""
    for first, own, pages in _parts(batches):
        runs = np.unique(np.array([r["run"] for r in own], np.int64)) if first["parts"] > 1 else None
        found = unique_runs([r["blocks"] for r in pages], [r["roles"] for r in pages], runs)
        columns = [pa.array([r["page_id"] for r in pages], pa.int64()), pa.array([r["url"] for r in pages], pa.string()), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
        yield from sliced(pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_repeated"]), 256)


def _dealt(pages: DataFrame, own: DataFrame) -> DataFrame:
    """Pages, and rows of kind 0 with some of their columns, by host and part."""
    rows = own.withColumn("kind", F.lit(0)).unionByName(pages.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition(partitions(pages.sparkSession), "host", "part").sortWithinPartitions("host", "part", "kind")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated for every row of pages(page_id, url, html).

    Blocks of the article in page order, character references decoded, white space inside a block as one
    space, joined by one line feed. Without an article or main element: the blocks that neither structure
    nor the host's repeated substrings rule out. n_repeated: words of the text that they cover. Null and empty pages, and pages without text: ''. Rows
    that repeat, or lack an id or a url, give as many rows (pages without a host form one host); an empty
    table gives none. Other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).alias("parts")).where("parts > 1")
    sizes = F.broadcast(written(sizes, "hosts"))  # a row for HOST_PAGES pages at most

    def streams(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).alias("part")
        schema = "host string, part long, parts long, page_id long, url string, blocks array<string>, roles array<int>"
        return rows.select("host", part, "parts", "page_id", "url", "html").mapInArrow(_parse, schema)

    outside = F.transform(F.filter(F.arrays_zip("blocks", "roles"), lambda x: x["roles"] != TEXT), lambda x: x["blocks"])
    large = streams(rows.join(sizes, "host")).withColumn("digest", F.md5(F.concat_ws("\0", outside).cast("binary")))
    counts = large.groupBy("host", "digest").agg(F.min("part").alias("part"))  # equal streams count once
    runs = written(_dealt(large, counts).mapInArrow(_count, "host string, part long, run long, pages long"), "runs")
    often = runs.groupBy("host", "run").agg(F.sum("pages").alias("n")).where(F.col("n") >= PAGES).drop("n")
    own = written(runs.join(often, ["host", "run"], "left_semi").select("host", "part", "run", F.lit(2).cast("long").alias("parts")), "repeated")
    discard(runs)
    every = streams(rows.join(sizes, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))))
    found = _dealt(every, own).mapInArrow(_clean, "page_id long, url string, text string, n_repeated long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
