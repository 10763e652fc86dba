"""Wrapper inference and extraction on the table and on pages of known content."""

import html
import re
from collections import Counter

from runledger.llm.wrappers import expression, extract, folded, host_wrappers, main_text, marked, merged, parse, shown

SCHEMA = "page_id long, url string, html string, text string"


def wrapper(*pages):
    tree = expression(parse(pages[0]))
    for page in pages[1:]:
        tree = merged(tree, expression(parse(page)))
    return tree


def test_expressions():
    one = wrapper("<ul><li>a<li>b</ul><p>x", "<ul><li>a<b>c</b></ul>")
    assert shown(one) == "(ul((li(# b(#)?))+) p(#)?)" or shown(one) == "(ul((li(# (b(#))?))+) (p(#))?)" or "(li(# (b(#))?))+" in shown(one)
    pairs = wrapper("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert shown(pairs).count("dt") == 1 and "(dt(#))+" in shown(pairs)
    assert folded([]) == []


PAGE = """<!doctype html><html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></li><li>B</ul></nav>
<div class="cookie-notice">We use cookies</div>{before}<article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld&nbsp;word<br>next
line<p>Two <i>x</i><form><input value=q>Search</form><aside>Side</aside><div class="share">Share!</div></article>
<div id="comments"><p>A reader says</p></div><div class="sidebar">links</div><footer>&copy; us</footer></body></html>"""


def test_content_of_an_article():
    tree = marked(wrapper(PAGE.format(before=""), PAGE.format(before='<div class="ad">Buy</div>')))
    got = main_text(parse(PAGE.format(before='<div class="ad">Buy</div>')), tree)
    assert got == "Title & more One bold word next line Two x"


def test_content_without_an_article():
    page = "<body><div id=top><a href=/>Home</a> <a href=/b>News</a></div><div class=c><h2>T</h2><p>{0}</p><p>{0} end</p></div><div class=footer>f</div>"
    pages = [page.format("words of text " * n) for n in (5, 9, 14)]
    tree = marked(wrapper(*pages))
    assert [main_text(parse(p), tree) for p in pages] == [("T " + ("words of text " * n) * 2 + "end") for n in (5, 9, 14)]


def test_table_and_hard_pages(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rows = [(r.page_id, r.url, r.html, "x") for r in real]
    hard = [None, "", "plain text  only", "<", "<p", "a < b <p>c", "<p>" * 3000 + "deep", "<div>" * 900 + "x", "<a href=\"" * 200, "<script>never ends", "</p></div>z",
            "<article>" + "<p>long text of words</p>" * 20000 + "</article>", "&amp &am &#65; &nosuch;"]
    rows += [(9000 + i, ["http://h.example/x", None, "no address"][i % 3], p, None) for i, p in enumerate(hard)] + [(None, None, None, None)] + rows[:4]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = extract(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((i, u) for i, u, _, _ in rows)
    text = {r.page_id: r.text for r in got}
    for r in real:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = html.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.sub("</?b>", "", body)))
        assert text[r.page_id] == " ".join(want.split())
    assert text[9000] == text[9001] == "" and text[9002] == "plain text only" and text[9010] == "z" and text[9011].count("long") == 20000
    assert all(r.n_chars == len(r.text) for r in got) and text[None] == ""
    names = [r.host for r in host_wrappers(df).collect()]
    assert len(names) == len(set(names)) and extract(df.limit(0)).count() == 0


def read(*pages):
    tree = marked(wrapper(*pages))
    return [main_text(parse(p), tree) for p in pages]


def test_articles_in_parts_with_a_cue_in_their_names():
    body = "<nav>Home</nav>{0}<article><h1>Title</h1><p>Some words of text</p></article>{1}<footer>us</footer>"
    for start, end in (('<div class="page has-sidebar">', "</div>"), ("<div class=no-sidebar>", "</div>"), ('<section id="with-nav">', "</section>"),
                       ("<div class=widget-area-off>", "</div>"), ("<form id=f>", "</form>"), ("<div class=sidebar>", "</div>"), ("<form><div class=promo>", "</div></form>")):
        for ad in ("", "<div class=ad>Buy</div>", '<div class="cookie-bar">' + "We use cookies. " * 20 + "</div>"):
            assert read(body.format(start + ad, end)) == ["Title Some words of text"], (start, ad)
    page = "<article><p>Main words</p></article><div class=related-posts><article><p>Another</p></article></div>"
    assert read(page) == ["Main words"]


def test_blocks_whose_names_hold_a_cue():
    page = ("<article><p>One</p><div class=share-price-analysis><p>Two</p></div><div class='header-text alert'><p>Three</p></div>"
            "<div class=share-buttons>Share</div><div class=comment-list>Reader</div><div class='ad ad-300'>Buy</div></article>")
    assert read(page) == ["One Two Three"]
    form = "<body><form><div class=top><a href=/>Home</a></div><div class=c><p>" + "long text " * 30 + "</p></div></form></body>"
    assert read(form) == [("long text " * 30).strip()]
    most = "<body><div class=nav-x><a href=/>Home</a></div><div class=widget><p>" + "long text " * 30 + "</p></div></body>"
    assert "long text" in read(most)[0]


def test_ids_of_pages_do_not_grow_the_wrapper(spark):
    def page(i):
        rows = "".join(f'<p id="row-{i}-{j}">sentence {j} of page {i}</p>' for j in range(3))
        return f'<body><div id="sidebar">links</div><div class="post-{i} entry" id="slug-{"abcdefghij"[i % 10] * (i // 10 + 1)}"><article>{rows}</article></div></body>'

    sizes = []
    for n in (20, 200):
        df = spark.createDataFrame([(i, "http://one.example/", page(i)) for i in range(n)], "page_id long, url string, html string")
        sizes.append(len(host_wrappers(df).first()["tree"]))
        texts = {r.page_id: r.text for r in extract(df).collect()}
        assert texts == {i: " ".join(f"sentence {j} of page {i}" for j in range(3)) for i in range(n)}
    assert sizes[1] < sizes[0] + 60


NOTICE = "<p>This text may hold links to our <a href=/p>partners</a>.</p>"


def test_sentences_of_all_pages_are_constants(spark):
    own = lambda i, n=3: [f"sentence {j} of page number {i} with own words" for j in range(n)]
    layouts = {
        "article": "<body><nav>Home</nav><article><h1>What we know about it</h1>{0}</article><footer>us</footer></body>",
        "div": "<body><div class=top><a href=/>Home</a></div><div class=c>{0}</div><div class=end><a href=/us>us</a></div></body>",
    }
    for name, layout in layouts.items():
        head = "What we know about it " if name == "article" else ""
        for n in (9, 10, 40):
            # the notice stands before, among or after the paragraphs of a page
            bodies = [[f"<p>{s}" for s in own(i)] for i in range(n)]
            for i, b in enumerate(bodies):
                b.insert(i % 4, NOTICE)
            df = spark.createDataFrame([(i, "http://one.example/", layout.format("".join(b)), None) for i, b in enumerate(bodies)], SCHEMA)
            df = df.unionByName(df.limit(3)).unionByName(spark.createDataFrame([(77, "http://one.example/", None, None)], SCHEMA)).repartition(4)
            texts = {r.page_id: r.text for r in extract(df).collect()}
            for i in range(n):
                want = own(i)
                if n < 10:
                    want.insert(i % 4, "This text may hold links to our partners.")
                assert texts[i] == head + " ".join(want), (name, n, i)
            assert texts[77] == ""


def test_sentences_that_stay():
    page = "<article>{0}</article>"
    notice = "This text may hold links to our partners."
    texts = [f"<p>words of page number {i} and then some more of them at length</p>" for i in range(12)]
    assert all(notice in t for t in read(*(page.format(x + (NOTICE if i else "")) for i, x in enumerate(texts)))[1:])  # one page lacks it
    copies = [page.format(NOTICE + texts[0] + f"<p>copy {i}</p>") for i in range(12)]
    assert all(notice in t and "words of page" in t for t in read(*copies))  # most of the text is equal
    assert all(notice in t for t in read(*[page.format(NOTICE + texts[i % 3]) for i in range(30)]))  # three different pages
    cells = [page.format(f"{x}<table><tr><td>Yes<td>{i}</table><p>So it is.") for i, x in enumerate(texts)]
    assert all(t.endswith(f"Yes {i} So it is.") for i, t in enumerate(read(*cells)))
