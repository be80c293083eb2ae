"""op1: structure on hand-made pages, repeats against brute force."""

import random
import time
from html.parser import HTMLParser

import numpy as np

from tessera.llm import html_extract as H
from tessera.llm.html_extract import PAGES, PAGE_SHARE, RUN, main_text, parsed, repeated

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body class="post sidebar-left">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad banner">Buy <p>now</div>
<div id="cookie-notice">We use cookies</div><article class="post"><header><h1>Title &amp; more</h1></header>
<p><b>First&nbsp;&#233; <i>line</i><br>goes on<p>Second &lt;p&gt;   line
</p><form><input value="q">Search</form><ul><li>one<li>two <a href="x">link</a></ul><aside>Side</aside>
<script>document.write("<p>no</p>")</script><table><tr><td>a</td><td>b</td></tr></table><div class="share">Share</div>
<footer>By me</footer></article><section id="comments"><article class="comment"><p>I say a very long reader comment here, much longer than the article itself is.</p></article></section>
<footer>&copy; Site</footer></body></html>"""


def test_article():
    text = parsed(PAGE)[0]
    assert text.split("\n") == ["Title & more", "First é line goes on", "Second <p> line", "one", "two link", "a", "b"]
    assert parsed("<body><div class=ad>Buy<article><p>Real text</p></article></body>")[0] == "Real text"
    assert parsed("<main><p>In main</p><nav>x</nav></main>")[0] == "In main"
    assert parsed("<article><p>a <b>b</article>")[0] == "a b"
    assert parsed("<ARTICLE><P>1 < 2 & 3 > 2</P></ARTICLE>")[0] == "1 < 2 & 3 > 2"
    assert parsed("<article><p title='a>b' class=\"x\">t<!-- <p>no</p> --></p><p hidden>h</p></article>")[0] == "t"
    assert parsed('<div class="wrap with-sidebar"><p>x</p><article><p>kept</p></article></div>')[0] == "kept"
    assert parsed('<div class="related"><article><p>card</p></article></div><article><p>kept</p></article>')[0] == "kept"
    assert parsed('<div>Menu of site</div><div id="main-content"><p>kept</p><div class="ad">x</div></div><div>about us</div>')[0] == "kept"
    assert parsed('<article><p>kept</p><div class="notice">n</div><div id="reader-comments"><p>c</p></div></article>')[0] == "kept"
    assert parsed("<main><h1>Site</h1><p>kept</p></main>")[0] == "Site\nkept"
    assert parsed("<main><div>Read also</div><article><h1>T</h1><p>kept</p></article><div>More</div></main>")[0] == "T\nkept"
    assert parsed("<article><p>the article itself</p><article><p>a reader's words</p></article></article>")[0] == "the article itself"
    assert parsed(None) == ("", [], []) and parsed("plain  text") == (None, ["plain text"], [H.OPEN])


def test_inline_pieces_are_ruled_out_one_by_one():
    text = lambda page: parsed(f"<article>{page}</article>")[0]
    assert text('<p>A <span class="advert">BUY NOW</span> B</p>') == "A B"
    assert text("<p>Read <button>Subscribe</button>on, <label>Mail <input></label>and<noscript>x</noscript> on</p>") == "Read on, and on"
    assert text('<p>Seen<span style="display: none">hidden</span> <span hidden>h</span><i aria-hidden="true">i</i>text</p>') == "Seen text"
    assert text("<p>Before <select><option>one<option>two</select> after</p>") == "Before\nafter"
    assert text('Keep me <span class="ad"><div>x</div></span> and me') == "Keep me\nand me"
    assert text('<p><span class="comments-count">a whole paragraph</p><p>b</p>') == "a whole paragraph\nb"
    assert text("Real text <button>Go") == "Real text"
    assert text("<p>one <a class='share-link' href=x>Share</a>two <b>three</b></p>") == "one two three"
    assert text("<p>a <b>b</p><div class=ad>x <b>y</div><p>c</p>") == "a b\nc"


def test_names():
    no, perhaps, layout, good = H.NO, H.PERHAPS, H.LAYOUT, H.FOR_GOOD
    for name, want in {"related-work": perhaps, "discussion": perhaps, "share-of-voice": perhaps, "adSlot": layout, "relatedPosts": good, "comment-list": good, "with-sidebar": perhaps, "shared": no, "header": layout, "menu_items": layout, "newsletter": good, "adverb": no, "reader-comments": good, "cookie-recipe": perhaps}.items():
        assert H._name_rules_out(name, False) == want, name
    assert H._name_rules_out("header", True) == H.NO


def test_every_article_counts():
    long, short = "a long text of many words " * 20, "a short text"
    assert parsed(f"<article><p>{long}</p></article><article><p>{short}</p></article>")[0].split("\n") == [long.strip(), short]
    assert parsed(f'<article><p>{long}</p></article><article><a href="x">read this other page of ours</a> now</article>')[0] == long.strip()


def brute_text(page):
    """The text of well-formed pages by the standard library's parser: a part is out if an element around it is; blocks are cut at block elements."""
    out, stack, blocks = [], [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            names = dict(attrs)
            if tag in ("p", "div", "article", "nav", "footer", "aside", "h1", "ul", "li", "form"):
                blocks.append("")
            if tag not in ("br", "input"):
                gone = tag in ("nav", "footer", "aside", "form", "button", "script", "style") or "hidden" in names or names.get("class") in ("ad", "comments", "cookie-notice", "share-buttons", "sidebar")
                stack.append((tag, gone))
            elif tag == "br" and blocks:
                blocks[-1] += " "

        def handle_endtag(self, tag):
            stack.pop()
            if tag in ("p", "div", "article", "nav", "footer", "aside", "h1", "ul", "li", "form"):
                blocks.append("")

        def handle_data(self, data):
            if any(t == "article" for t, _ in stack) and not any(g for _, g in stack):
                blocks[-1] += data

    reader = Reader(convert_charrefs=True)
    reader.feed(page)
    reader.close()
    out = [" ".join(b.split()) for b in blocks]
    return "\n".join(b for b in out if b)


def test_pages_against_another_parser(spark):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["one", "two &amp; more", "&eacute;t&#233;", "a &lt; b", "word", "  spaced\n"]) for _ in range(rng.randrange(1, 8)))
    names = ["ad", "comments", "cookie-notice", "share-buttons", "sidebar", "intro", "body-text", "lead"]

    def inline(depth):
        kind = rng.randrange(7)
        if kind < 3 or depth > 2:
            return say()
        if kind == 3:
            return f"{say()}<br>{say()}"
        if kind == 4:
            return f'<span class="{rng.choice(names)}">{inline(depth + 1)}</span>'
        tag = rng.choice(["b", "i", "em", "button", "u"])
        return f"<{tag}>{inline(depth + 1)}</{tag}>"

    def block(depth):
        kind = rng.randrange(6)
        if kind < 3 or depth > 3:
            return f"<p{rng.choice(['', '', ' hidden'])}>{inline(0)} {inline(0)}</p>"
        if kind == 3:
            return f"<ul>{''.join(f'<li>{inline(0)}</li>' for _ in range(rng.randrange(4)))}</ul>"
        tag, name = rng.choice([("div", f' class="{rng.choice(names)}"'), ("nav", ""), ("aside", ""), ("footer", ""), ("form", ""), ("div", "")])
        return f"<{tag}{name}>{''.join(block(depth + 1) for _ in range(rng.randrange(1, 4)))}</{tag}>"

    rows = []
    for i in range(400):
        inside = "".join(block(0) for _ in range(rng.randrange(1, 8)))
        rows.append((i, f"http://h{i % 7}.example.com/{i}", f"<html><body>{block(0)}<article><h1>{say()}</h1>{inside}</article>{block(0)}</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: brute_text(h) for i, _, h in rows}
    assert {r.page_id: r.text for r in main_text(df).collect()} == want and sum(map(len, want.values())) > 10_000


def test_the_array_decides_undecided_parts_of_articles(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    house = "All that we sell is listed in our own shop as it has been for years"
    rows, want = [], {}
    for i in range(9):
        own, more = (" ".join(word() for _ in range(20)) for _ in "ab")
        rows.append((i, "https://h.example.com/", f'<article><p>{own}</p><div class="related-work">{more}</div><div class="social-disclaimer">{house}</div></article>'))
        want[i] = f"{own}\n{more}"
    rows.append((50, "https://once.example.com/", f'<article><p>kept</p><div class="disclaimer">{house}</div></article>'))
    want[50] = f"kept\n{house}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (512, 2):
        H.HOST_PAGES, old = size, H.HOST_PAGES
        try:
            assert {r.page_id: r.text for r in main_text(df).collect()} == want
        finally:
            H.HOST_PAGES = old


def test_end_tags_reach_any_depth():
    open_tags = "<font>x<br>" * 500
    assert parsed(f"<article><p>a</p><aside>{open_tags}</aside><p>b</p></article>")[0] == "a\nb"
    assert parsed(f"<article><p>a {open_tags}</article><p>after the article</p>")[0].endswith("x")


def test_malformed_pages_are_linear():
    began = time.time()
    for t in ("<" * 300_000, "<a b='" * 100_000, '<p class="' * 100_000, "<div>" * 200_000, "<!--" * 100_000, "<script>" * 100_000, "&" * 300_000, "<p><b>" * 100_000, "</b>" * 100_000, "<b>" * 50_000 + "<hr>" * 50_000, "<div>" * 50_000 + "<nav>" + "<article>" * 50_000 + "</nav>", "<span class=ad>x" * 50_000):
        parsed(t)
        parsed("<article>" + t)
    assert time.time() - began < 40


def test_repeats_against_brute_force():
    rng = np.random.default_rng(0)
    boiler = rng.integers(1, 50, 20)
    streams = [np.concatenate([rng.integers(1, 50, rng.integers(0, 30)), boiler[: rng.integers(5, 20)], rng.integers(1, 9, rng.integers(0, 12))]) for _ in range(25)]
    streams += [streams[0].copy(), np.empty(0, np.int64)]
    kinds = {s.tobytes() for s in streams}
    where: dict = {}
    for s in streams:
        for i in range(len(s) - RUN + 1):
            where.setdefault(tuple(s[i : i + RUN]), set()).add(s.tobytes())
    for s, got in zip(streams, repeated(streams)):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - RUN + 1):
            if len(where[tuple(s[i : i + RUN])]) >= max(PAGES, PAGE_SHARE * len(kinds)):
                want[i : i + RUN] = True
        assert got.tolist() == want.tolist()


def test_host_boilerplate(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows, want = [], {}
    for i in range(60):
        own = " ".join(word() for _ in range(30))
        rows.append((i, f"https://h.example.com/{i}", f"<body><div>Welcome to the site of all sites where we write</div><div>{own}</div><div>All rights of this site are reserved by the site of all sites {word()}</div></body>"))
        want[i] = own
    rows += [(100, "https://other.example.com/", "<p>alone on its host</p>"), (101, None, None), (101, None, None), (102, "x", ""), (None, "http://h.example.com/z", "<article>kept &amp; whole</article>")]
    want |= {100: "alone on its host", 101: "", 102: "", None: "kept & whole"}
    rows += [(200 + i, "https://copies.example.com/", "<div>the same long page is here many times over for sure</div>") for i in range(5)]
    want |= {200 + i: "the same long page is here many times over for sure" for i in range(5)}
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = main_text(df.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert main_text(df.limit(0)).collect() == []
    monkeypatch.setattr(H, "HOST_PAGES", 20)
    assert {r.page_id: r.text for r in main_text(df).collect()} == want


def test_large_hosts_count_as_a_whole(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    notice = "This section of the site is read by all its friends"
    rows, want = [], {}
    for i in range(1200):
        own = " ".join(word() for _ in range(20))
        rows.append((i, f"https://large.example.com/{i}", f"<div>{own}</div>" + (f"<div>{notice}</div>" if i % 100 == 0 else "") + ("<div>only these two pages say the same long thing</div>" if i in (3, 5) else "")))
        want[i] = own + ("\nonly these two pages say the same long thing" if i in (3, 5) else "")
    rows += [(2000 + i, f"https://large.example.com/c{i}", "<div>the same long page is here many times over for sure</div>") for i in range(40)]
    want |= {2000 + i: "the same long page is here many times over for sure" for i in range(40)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (2000, 512, 50):
        monkeypatch.setattr(H, "HOST_PAGES", size)
        assert {r.page_id: r.text for r in main_text(df).collect()} == want


def test_the_array_judges_every_page(spark, monkeypatch):
    """Also pages that structure decides by itself: what the host repeats outside text is counted in it, and stays."""
    notice = "all rights to these words are kept by the house that prints them"
    pages = [(i, "http://own.host/a", f"<article><p>words of page number {i}</p><p>{notice if i in (0, 7) else 'short'}</p></article><footer>{notice} {i}</footer>") for i in range(8)]
    pages += [(20 + i, "http://two.host/a", f"<article><p>{notice}</p></article><footer>{notice if i < PAGES - 1 else ''} {i}</footer>") for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (512, 2):
        monkeypatch.setattr(H, "HOST_PAGES", size)
        got = {r.page_id: (r.text, r.n_repeated) for r in main_text(df).collect()}
        repeats = len(notice.split())
        assert got == {i: (f"words of page number {i}\n{notice}", repeats) if i in (0, 7) else (f"words of page number {i}\nshort", 0) for i in range(8)} | {20 + i: (notice, 0) for i in range(6)}
