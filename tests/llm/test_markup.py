"""Main text of pages: element rules one by one, and what a site repeats."""

from __future__ import annotations

import re

import pytest

from maillode.llm import markup

PAGES = "page_id long, url string, html string"


def text_of(source, template=frozenset()):
    return markup.page_text(source, template)[0]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup  at\nall", "no markup at all"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p><b>bold<br>and more<p>two</b> rest</p>", "bold and more\n\ntwo rest"),
        ("<p>a&amp;b &lt;i&gt; &eacute;&#233;&#xe9; &copy 2 &am", "a&b <i> ééé © 2 &am"),
        ("<p>x<script>var t='</p>';</script>y<style>p{}</style></p>", "xy"),
        ("<script>never ends <p>text</p>", ""),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", "yes"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p title='a>b' lang=\"x>y\">t</p><p", "t"),
        ("<p>cut <a href='x", "cut"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"),
        ("<table><tr><td>a<td>b<tr><th>c</th></tr></table>", "a b\n\nc"),
        ("a<div>b<span>c</span>d</div>e", "a\n\nbcd\n\ne"),
        ("<head><title>t</title><meta x></head><body><p>b</p>", "b"),
        ("<title>t</title><p>b</p>", "b"),
        ("<nav>m</nav><header>h</header><p>b</p><aside>s</aside><footer>f</footer>", "b"),
        ("<form>f<input></form><button>x</button><select><option>o</select>b", "b"),
        ("<nav>m</nav>x<article><h1>T</h1><p>b</p><footer>f</footer></article>y", "T\n\nb"),
        ("<article><header><h1>T</h1></header><p>b</p><div class='ad'>x</div></article>", "T\n\nb"),
        ("<article>a</article><section id=comments><article>c</article></section>", "a"),
        ("<div class='comments-open'><article>a</article></div>", "a"),
        ("<article>a<div class=related><article>t</article></div></article>", "a"),
        ("<article>a</article><article>b</article>", "a\n\nb"),
        ("<article>a</article><article class=comment>c</article>", "a"),
        ("<article>a<div class='commentlist'><article>c</article></div></article>", "a"),
        ("<main><p>a</p><div class=share-buttons>s</div></main><p>x</p>", "a"),
        ("<div role=main>a</div>b", "a"),
        ("<body class=sidebar><div class='page has-sidebar'><h1>T</h1>b</div></body>", "T\n\nb"),
        ("<form id=f><article>a</article></form>", "a"),
        ("<div class=cookie-notice>c</div><div class=adBox>x</div><div class=roadAhead>r</div>", "r"),
        ("<div class=wrapper><div class=adopted>k</div></div>", "k"),
        ("<p>a<svg><title>t</title><path/></svg>b", "ab"),
        ("<P CLASS=AD>x</P><P>y</P>", "y"),
        ("<p>nbsp   here</p>", "nbsp here"),
        ("</p></div>x</b>", "x"),
        ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_elements(source, text):
    assert text_of(source) == text


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "in" + "</div>" * 3000
    assert text_of(deep) == "in"
    assert text_of("<p>word " * 20_000).count("\n\n") == 19_999
    assert text_of("<a " + "b='" * 20_000) == ""


def site(host, n, template, article="<div class=x{0}><p>Own text {0} of the page.</p></div>"):
    return [(i, f"https://{host}/{i}?q=1", f"<body>{template}{article.format(i)}</body>") for i in range(n)]


def texts(frame):
    return {(r["page_id"], r["url"]): r["text"] for r in frame.collect()}


def test_what_a_site_repeats_goes(spark):
    box = "<div class=q7><p>Get our letter</p><ul><li>Home<li>News</ul></div>"
    rows = site("a.example", 12, box) + site("b.example", 2, box)
    rows += [(90, "https://a.example/only", f"<body>{box}</body>"), (91, None, f"<body>{box}</body>")]
    rows += [(92, "https://c.example/1", None), (92, "https://c.example/1", None), (None, "no address", "<p>x")]
    frame = spark.createDataFrame(rows, PAGES).repartition(3).selectExpr("*", "1 AS host", "2 AS text")
    got = markup.main_text(frame)
    assert got.count() == len(rows)
    found = texts(got)
    for i in range(12):
        assert found[i, f"https://a.example/{i}?q=1"] == f"Own text {i} of the page."
    boxed = "Get our letter\n\nHome\n\nNews"
    for i in range(2):  # too few pages to tell
        assert found[i, f"https://b.example/{i}?q=1"] == f"{boxed}\n\nOwn text {i} of the page."
    assert found[90, "https://a.example/only"] == boxed  # nothing else is there
    assert found[91, None] == boxed
    assert found[92, "https://c.example/1"] == ""
    assert found[None, "no address"] == "x"


def test_an_article_stays_however_often_it_comes(spark):
    common = "<article><h1>T</h1><p>Shared passage.</p><blockquote>Quoted.</blockquote><p>Page {0}</p></article>"
    same = "<article><div><p>One text on all pages</p></div></article>"
    rows = site("a.example", 30, "<nav>menu</nav>", common)
    rows += site("b.example", 30, "<div>Bar</div>", same)
    found = texts(markup.main_text(spark.createDataFrame(rows, PAGES)))
    for i in range(30):
        assert found[i, f"https://a.example/{i}?q=1"] == f"T\n\nShared passage.\n\nQuoted.\n\nPage {i}"
        assert found[i, f"https://b.example/{i}?q=1"] == "One text on all pages"


def test_paragraphs_outside_of_articles_need_a_larger_share(spark):
    rows = [(i, f"http://user@H.example:80/{i}", f"<p>Every page</p><p>Own {i}</p>" + "<p>Some</p>" * (i % 5 == 0)) for i in range(40)]
    found = texts(markup.main_text(spark.createDataFrame(rows, PAGES)))
    assert set(found.values()) == {f"Own {i}" + "\n\nSome" * (i % 5 == 0) for i in range(40)}


def test_templates_against_plain_counting(spark):
    rows = [
        (i, f"https://h{i % 3}.example/{i}", f"<div>d{i % 7}</div><ul><li>l{i % 2}</ul><p>{i}</p>")
        for i in range(60)
    ]
    counts, sizes = {}, {}
    for _, url, source in rows:
        host = re.search("//([^/]*)", url)[1]
        sizes[host] = sizes.get(host, 0) + 1
        for own in set(markup.read_page(source).subtrees()[0].values()):
            counts[host, own] = counts.get((host, own), 0) + 1
    want: dict = {}
    for (host, own), n in counts.items():
        share = markup.LEAST_SHARE_OF_TEXT if own & 1 else markup.LEAST_SHARE
        if n >= markup.LEAST_PAGES and n >= share * sizes[host]:
            want.setdefault(host, []).append(own)
    got = markup.site_templates(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["host"]: r["template"] for r in got} == {h: sorted(t) for h, t in want.items()}


def test_registered_query_on_its_table(spark):
    from maillode.llm.queries import QUERIES

    got = QUERIES["op13_main_text"](spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = got.collect()
    assert sorted(r["page_id"] for r in rows) == sorted(sources)
    for row in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", sources[row["page_id"]], re.S)
        plain = re.sub(r"<[^>]*>|<[^>]*$", " ", article[1] if article else "")
        known = markup.entities.unescape(plain).split()
        assert row["text"].split() == known and row["n_chars"] == len(row["text"])


def test_empty_table(spark):
    assert markup.main_text(spark.createDataFrame([], PAGES)).count() == 0
