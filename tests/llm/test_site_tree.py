"""Extraction rules on small pages, the tree's evidence, and odd rows."""

import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sigilframe.llm import site_tree as st

PAGES = "page_id long, url string, html string"


def text_of(spark, html, url="http://h.example/x"):
    return st.extract_text(spark.createDataFrame([(1, url, html)], PAGES)).first().text


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>T &amp; t</h1><p>a  b\n c<p>d<b>e</b>f</article>", "T & t a b c def"),
        ("<nav>menu</nav><main><p>x</p></main><footer>&copy; me</footer>", "x"),
        ("<article><p>one<br>two</p><div class='comments'><p>nice!</p></div><aside>s</aside></article>", "one two"),
        ("<article><script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> --></article>", "yes"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>t</p></article>", "Title t"),
        ("<article><form><label>Name</label><input></form><p>kept&nbsp;here &#233;&#x1F389;</p></article>", "kept here é🎉"),
        ("<div id=cookie-notice>ok?</div><article><p>p <a href='x'>link</a>, end</p></article>", "p link, end"),
        ("<article><p>un<b>closed <p>next", "unclosed next"),
        ("<article><p title='a>b'>x</p><p hidden>no</p><ul><li>1<li>2</ul></article>", "x 1 2"),
        ("plain words only", "plain words only"),
        ("", ""),
        (None, ""),
    ],
)
def test_rules(spark, html, want):
    assert text_of(spark, html) == want


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "page-header", "ad-free", "search-content"])
def test_a_wrapper_of_the_article_is_no_noise(spark, name):
    side = "<div class='sidebar'><article>card</article>side</div><div class='comments'><article>nice</article></div>"
    assert text_of(spark, f"<div class='{name}'><h1>T</h1><article><p>own text</p><div class=share>s</div></article>{side}</div>") == "T own text"
    assert text_of(spark, f"<main><h1>T</h1><div id='{name}'><article>own text</article></div></main>") == "T own text"
    assert text_of(spark, f"<body class='{name}'><div class='{name}'><main><p>own text</p>{side}</main></div></body>") == "own text"
    assert text_of(spark, f"<div class='{name}'>menu</div><article>own text</article>{side}") == "own text"
    assert text_of(spark, f"<nav><div class='{name}'><article>card</article></div></nav><p>own text</p>") == "own text"


def test_repeated_branches_go_and_unique_ones_stay(spark):
    """Without any telling tag or class, what a host's pages repeat is removed."""
    rows = [(i, f"http://one.example/{i}", f"<body><div class=top>Same on all</div><div class=text><p>Own words of {i}</p></div><div class=low>All alike</div></body>") for i in range(12)]
    rows += [(99, "http://two.example/1", "<body><div class=top>Same on all</div><p>alone</p></body>")]
    out = {r.page_id: r.text for r in st.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == {r.page_id: r.text for r in st.extract_text(spark.createDataFrame(rows, PAGES), small=-1).collect()}
    assert all(out[i] == f"Own words of {i}" for i in range(12))
    assert out[99] == "Same on all alone"  # a host of one page gives no evidence


def plain_importance(pages):
    """Of each path of tags and classes in (host, html) pages of well-formed div and p, by counting."""

    class Reader(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.at, self.children, self.texts = [], {}, []
            self.feed(html)

        def handle_starttag(self, tag, attrs):
            own = tag + "".join(f".{v}" for k, v in attrs if k == "class")
            self.children.setdefault(tuple(self.at), []).append(own)
            self.at.append(own)

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            self.texts.append((tuple(self.at), data.strip()))

    out = {}
    for host in {h for h, _ in pages}:
        read = [Reader(html) for h, html in pages if h == host]
        paths = {p for r in read for p, _ in r.texts}
        held = sum(len(t) for r in read for _, t in r.texts)

        def presentation(p, read=read):
            kinds = Counter(tuple(r.children.get(p, ())) for r in read if any(x[: len(p)] == p for x, _ in r.texts))
            m = sum(kinds.values())
            return -sum(k / m * math.log(k / m, m) for k in kinds.values()) if m > 1 else 1

        for p in paths:
            having = [r for r in read if p in {x for x, _ in r.texts}]
            m = len(having)
            pages_of = Counter(t for r in having for t in {t for x, t in r.texts if x == p})
            beside = {t: {max((x for x in r.texts if x[0] != longest(r)), key=lambda x: len(x[1]), default=("", ""))[1] if p == longest(r) else max(r.texts, key=lambda x: (len(x[1]), x[1]))[1] for r in having if (p, t) in r.texts} for t in pages_of}
            entropy = sum(math.log(k, m) for t, k in pages_of.items() if len(beside[t]) > 1) if m > 1 else 0
            content = 1 - entropy / len(pages_of)
            share = sum(len(t) for r in having for t in {t: 1 for x, t in r.texts if x == p}) / held
            setting = min(1, max(presentation(p[:-1]), share / st.VOLUME)) if m > 1 else 1
            out[host, m, round(content, 9), round(content * (st.GAMMA + (1 - st.GAMMA) * setting), 9)] = p
    return out


def longest(reader):
    return max(reader.texts, key=lambda x: (len(x[1]), x[1]))[0]


def test_importance_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    pages = []
    for i in range(40):
        main = "".join(f"<p>{' '.join(word() for _ in range(20))}</p>" for _ in range(rnd.randint(1, 6)))
        slot = f"<div class=slot>{word()} {word()}</div>"
        pages.append((f"h{i % 3}.example", f"<div class=top><div class=a>{rnd.choice(['Home', 'Start'])}</div>{slot}</div><div class=main>{main}</div><div class=low>All alike</div>"))
    df = spark.createDataFrame([(i, f"http://{h}/", html) for i, (h, html) in enumerate(pages)], PAGES)
    got = {(r.host, int(r.m), round(r.content, 9), round(r.importance, 9)) for r in st.importance(st.site_evidence(df)).collect()}
    assert got == set(plain_importance(pages))
    out = {r.page_id: r for r in st.extract_text(df).collect()}
    for i, (_, html) in enumerate(pages):
        assert out[i].text == " ".join(re.findall("<p>(.*?)</p>", html))  # slots go though their words differ


class ArticleReader(HTMLParser):
    """What stands between <article> and </article>, blocks parted at every tag that isn't b."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.parts = False, []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts.append("" if tag == "b" else "\n")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts.append("" if tag == "b" else "\n")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_query_equals_the_articles_and_the_tree_finds_the_noise(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = st.extract_text(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == " ".join("".join(ArticleReader(html[r.page_id]).parts).split())
    removed, tree = sum(r.n_removed for r in rows), sum(r.n_tree for r in rows)
    assert 0.9 * removed < tree <= removed  # titles in the head and hosts of a page or two are left to the prior


def test_the_tree_needs_no_names(spark):
    """The pages of the table with all tags but p and h1 made div, and all classes taken: only the tree is left."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id < 1500")
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|nav|footer|ul|li)>", "<$1div>"))
    bare = bare.withColumn("html", F.regexp_replace("html", ' class="ad"', ""))
    want = {r.page_id: r.text for r in st.extract_text(pages).collect()}
    got = {r.page_id: r.text for r in st.extract_text(bare).collect()}
    words = lambda t: Counter(t.split())
    both = sum(sum((words(got[i]) & words(want[i])).values()) for i in want)
    assert both / sum(len(t.split()) for t in want.values()) > 0.97
    assert both / sum(len(t.split()) for t in got.values()) > 0.95


def test_article_stays_where_pages_repeat_each_other(spark):
    rows = [(i, "http://h.example/", "<nav>m</nav><article><p>same text</p></article>") for i in range(6)]
    assert {r.text for r in st.extract_text(spark.createDataFrame(rows, PAGES)).collect()} == {"same text"}


def test_repeated_branches_inside_the_article_go(spark):
    """Also there, without any telling tag or class; but not what copies of one article repeat."""
    box = "<div class=x7>Read these next</div>"
    rows = [(i, "http://one.example/", f"<main><h1>Title {i}</h1><p>Own words of page {i}</p>{box}<p>More of {i}</p></main>") for i in range(9)]
    same = "<p>Text that all copies have</p><blockquote>A quotation</blockquote>"
    rows += [(10 + i, "http://two.example/", f"<article><h1>T{i}</h1>{same}</article>") for i in range(5)]
    rows += [(20 + i, "http://three.example/", f"<article><p>Own words of page {i}</p></article>") for i in range(9)]
    rows += [(30 + i, "http://three.example/", f"<article>{same}</article>") for i in range(4)]
    rows += [(40 + i, "http://four.example/", f"<main><p>Own words of page {i}</p>{box}</main>") for i in range(2)]
    out = {r.page_id: r.text for r in st.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(out[i] == f"Title {i} Own words of page {i} More of {i}" for i in range(9))
    assert all(out[10 + i] == f"T{i} Text that all copies have A quotation" for i in range(5))
    assert all(out[20 + i] == f"Own words of page {i}" for i in range(9))
    assert all(out[30 + i] == "Text that all copies have A quotation" for i in range(4))
    assert all(out[40 + i] == f"Own words of page {i} Read these next" for i in range(2))  # two pages are no evidence


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 20_000 + "<p>core</p>"
    assert text_of(spark, deep) == "core"
    assert text_of(spark, "<b>" * 20_000 + "core") == "core"
    assert "x" in text_of(spark, '<article><p title="a>x</p><p>y</p></article>')


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>own</p><article class=comment>nice post</article></article>", "own"),
        ("<article><p>own</p></article><article class='comment-body'>nice post</article>", "own"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>own</p></article>", "Title own"),
        ("<div class='content no-sidebar'><p>own</p></div>", "own"),
        ("<article><p style='display:none'>no</p><p style='color:red'>foo<img src=x>bar</p></article>", "foobar"),
        ("<article><p>foo<o:p></o:p>bar <my-tag>baz</my-tag><picture><source><img></picture>!</p></article>", "foobar baz!"),
        ("<article><p>foo<script>x</script>bar<span hidden>no <i>n</i><span>o</span></span> baz</p></article>", "foobar baz"),
        ("<article><p>a<button>b<div>c</div></button>d</p><p>e</p></article>", "ad e"),
        ("<form id=aspnet><div><article><p>own</p></article></div><input></form>", "own"),
        ("<table><tr><td><nav>m</td></nav><td>own</table>", "own"),
        ("<article>MathML <math><mi>x</mi></math> stays</article>", "MathML x stays"),
        ("<div>" * 450 + "<nav>MENU</nav><p>core</p>", "core"),
        ("<b>" * 450 + "<nav>MENU</nav><p>core</p>", "core"),
    ],
)
def test_more_rules(spark, html, want):
    assert text_of(spark, html) == want


def test_long_broken_pages_take_time_in_proportion():
    def seconds(html):
        began = time.process_time()
        st.Page(html)
        return time.process_time() - began

    for part in ("<p a=\"x' ", "<b>", "<div><li>x</p>", "</q><!x", "<div class=nav><article>x", "<a href=x><td>y", "<span hidden>"):
        assert seconds(part * 80_000) < 40 * max(seconds(part * 8_000), 0.02)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "http://h/", "<p>b</p>"), (2, "not a url", None), (3, "", "")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("z"), "text": F.lit("z"), "removed": F.lit(1), "path": F.lit(2)})
    out = sorted((str(r.page_id), r.text, r.n_chars) for r in st.extract_text(df).collect())
    # the two pages without a url are one host, whose only text repeats
    assert [o[0] for o in out] == ["1", "1", "2", "3", "None"] and out[2] == ("2", "", 0) and out[4] == ("None", "b", 1)
    assert st.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ('<div class="market-share"><p>Shares rose.</p></div>', "Shares rose."),
        ('<div class="menu-item-recipe"><p>Soup of the day.</p></div>', "Soup of the day."),
        ('<section id="cookie-recipe"><p>Mix flour.</p></section>', "Mix flour."),
        ('<h2 class="social-history">Social history</h2><p>x</p>', "Social history x"),
        ('<p class="notice">A notice of the court.</p>', "A notice of the court."),
        ("<p>press <button>OK</button> now</p>", "press OK now"),
        ('<div class="discussion"><p>We discuss results.</p></div>', "We discuss results."),
        ('<div class="share-buttons">Share this</div><p>x</p>', "x"),
        ('<div class="cookie-notice">We use cookies</div><p>x</p>', "x"),
        ('<section class="related-posts"><p>More</p></section><p>x</p>', "x"),
        ('<ol class="comment-list"><li class="comment">nice</li></ol><p>x</p>', "x"),
        ('<p class="advert">Buy</p><p>x</p>', "x"),
        ('<div class="acme-related"><a href="/a">One</a> <a href="/b">Two</a></div><p>x</p>', "x"),
        ("<div><button>Play</button></div><form><p><button>Send</button></p></form><p>x</p>", "x"),
    ],
)
def test_names_inside_the_article(inside, want):
    """A word counts by itself only if it is the whole name; else the links or the tree decide."""
    page = st.Page(f"<article><h1>T</h1>{inside}<p>And so the text comes to its end.</p></article><div class='discussion'>great post</div>")
    kept, _ = st.prune(page, {})
    assert " ".join(b.text for b, k in zip(page.blocks, kept, strict=True) if k) == f"T {want} And so the text comes to its end."


def test_the_tree_decides_on_names_in_doubt(spark):
    """The same class: on one host a part that all pages share, on another the article's own."""
    page = lambda text, i: f"<article><h1>Title {i}</h1><p>Own words of {i} and many more of them.</p><div class='acme-notice'><p>{text}</p></div></article>"
    rows = [(i, f"http://one.example/{i}", page("Terms of our service apply.", i)) for i in range(10)]
    rows += [(100 + i, f"http://two.example/{i}", page(f"The {i}th notice was served.", i)) for i in range(10)]
    out = {r.page_id: r.text for r in st.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(10):
        assert out[i] == f"Title {i} Own words of {i} and many more of them."
        assert out[100 + i] == f"Title {i} Own words of {i} and many more of them. The {i}th notice was served."


def plainly_pruned(page, low):
    """prune by its definition: for each block, each branch above it is averaged over all blocks anywhere below."""

    def above(e):
        while e:
            yield e
            e = page.up[e]

    told = lambda b: low.get(b.path, (1.0, 1.0, True))
    outer = [b for b in page.blocks if b.state < 1]
    gone = []
    for b in page.blocks:
        value, _, sure = told(b)
        if b.state == 1:
            bound = st.LEAST_BESIDE if b.doubt else st.LEAST_INSIDE
            gone.append(sure and value < bound or b.doubt and 2 * b.links >= len(b.text))
            continue
        bound = st.LEAST_BESIDE if page.anchored and sure else st.LEAST
        low_branch = False
        for e in above(b.element):
            below = [x for x in outer if e in above(x.element)]
            weight = sum(len(x.text) for x in below)
            low_branch |= not page.holds[e] and sum(len(x.text) * told(x)[0] for x in below) < st.LEAST * weight
        gone.append(value < bound or bool(low) and low_branch)
    kept = []
    for b, g in zip(page.blocks, gone, strict=True):
        peers = [(x, y) for x, y in zip(page.blocks, gone, strict=True) if x.state == b.state]
        varied = lambda x: x.state == 1 or told(x)[1] >= 0.5
        lost = sum(len(x.text) for x, y in peers if y and varied(x))
        spared = 2 * lost > sum(len(x.text) for x, _ in peers) and (b.state == 1 or not page.anchored)
        kept.append(b.state >= 0 and (not g or varied(b) and spared))
    return kept, gone


@pytest.mark.parametrize("seed", range(30))
def test_prune_equals_brute_force(seed):
    rnd = random.Random(seed)

    def branch(depth):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            name = rnd.choice(["", " class=a", " class=b", " class=top-story", " class=sidebar", " class=acme-share", " class=share"])
            if depth and rnd.random() < 0.6:
                tag = rnd.choice(["div", "section", "ul"])
                parts.append(f"<{tag}{name}>{branch(depth - 1)}</{tag}>")
            else:
                text = "w" * rnd.randint(1, 30)
                parts.append(f"<p{name}>{rnd.choice([text, f'<a href=x>{text}</a> y', text + ' <a>l</a>'])}</p>")
        return "".join(parts)

    wrap = rnd.choice(["{}", "<article>{}</article>", "<main>{}</main>", "<main>{}<article>{}</article></main>", "{}<article>{}</article>{}"])
    page = st.Page(f"<body>{wrap.format(*(branch(3) for _ in range(3)))}</body>")
    for share in (0.0, 0.4, 1.0):
        low = {p: (rnd.choice([0.05, 0.19, 0.3, 0.36, 0.5, 0.59, 0.8]), rnd.random(), rnd.random() < 0.7) for p in sorted({b.path for b in page.blocks}) if rnd.random() < share}
        assert st.prune(page, low) == plainly_pruned(page, low)
