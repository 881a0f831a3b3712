"""Tokens, references, metadata, images, links and blocks."""

import html

import pytest
from pyspark.sql import functions as F

from pagequill.functions.entities import decode_entities
from pagequill.functions.html import token_array
from pagequill.functions.text import clean_text, keyword_tags, parse_date
from pagequill.operators import blocks, media, metadata, tokens


def pages(spark, *bodies):
    rows = [(i, "https://site.example/a/b", body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_references(apply):
    texts = [
        "a &amp; b", "&ampx", "&notit;", "&#128;", "&#0;", "&#x41", "&bogus;", "&#xD800;x", "&#99999999999;",
        "&Eacute;&eacute", "&#1;a", "&copy;&am", "&#x1F600;", "&NotEqualTilde;", "x&y;&&amp;", "&#xFFFE;", "&#150;",
        "&#129;", "&#13;", "&nbsp;|", "none",
    ]
    assert apply(decode_entities, texts) == [html.unescape(t) for t in texts]


def test_tokens_cover_the_page(spark):
    many = "<p " + " ".join(f"a{i}" for i in range(50_000)) + ">x</p>"
    texts = [many, "<a title=\"x>y\" B=1 b='2' c>t</a><!-- > --><script>\"</p>\"</script><br/>a<b", "", "<", "<!-- open"]
    kinds = [["open", "text", "close"], ["open", "text", "close", "comment", "raw", "self", "text", "text", "text"], [], ["text"], ["comment"]]
    rows = pages(spark, *texts).select("page_id", "html", token_array(F.col("html")).alias("t")).orderBy("page_id").collect()
    for row, kind in zip(rows, kinds):
        assert "".join(t.raw for t in row.t) == row.html
        assert [t.kind for t in row.t] == kind


def test_attributes_keep_order_and_doubles(spark):
    row = tokens.html_tokens(pages(spark, "<a title=\"x>y\" B=1 b='2' c href=/p/q?r=1&amp;s>t</a>")).filter("pos = 0").first()
    assert [tuple(a) for a in row.attrs] == [("title", "x>y"), ("b", "1"), ("b", "2"), ("c", ""), ("href", "/p/q?r=1&s")]


def test_dates(apply):
    dates = {
        "2026-9-2": "2026-09-02",
        "2026-09-22T23:30:00-08:00": "2026-09-22",
        "2026-09-22T23:30:00Z": "2026-09-22",
        "2026-09-22T23:30:00+0300": "2026-09-22",
        "2026-09-22T23:30:00.123456789+03:00": "",
        "2026-09-22T23:30:00.123": "",
        "2026-09-22T23:30:00.123+03:00": "2026-09-22",
        "5 SEP 2026": "2026-09-05",
        "sept 5, 2026": "",
        "September 5, 2026": "2026-09-05",
        "Sep  05,  2026": "2026-09-05",
        "2026-02-29": "",
        "2024-02-29": "2024-02-29",
        " 2026-01-01 ": "2026-01-01",
        "2026-01-01 10:00:00": "2026-01-01",
        "2026-01-01T25:00:00": "",
        "2026-01-01T10:00": "",
        "31 april 2026": "",
        "": "",
        "x": "",
        "2026-01-01T10:00:60": "",
        "2026-01-01T10:00:00+24:00": "",
        "2026-09-22T23:30:00+03:0000": "",
        "0000-01-01": "",
        "May 5, 2026": "2026-05-05",
    }
    assert apply(parse_date, list(dates)) == list(dates.values())


def test_clean_text_and_keywords(apply):
    assert apply(clean_text, ["  a  b!?  c_d-e'f.+ é中 "]) == ["a b c_d-e'f.+ é中"]
    assert apply(keyword_tags, ["alpha, beta,,  gamma ", ""]) == [["alpha", "beta", "gamma"], []]


def test_metadata_priority(spark):
    head = "<html><head><title>Page title</title>{}</head><body>{}</body></html>"
    cases = [
        # the first existing author element wins even when it is empty, then only itemprop is tried
        (head.format('<meta property="article:author" content="Alt"><meta name="author" content="">'
                     '<meta itemprop="author" content="Item">', "<h1>Big <b>head</b></h1>"), "Bighead", "Item", ""),
        # an h1 that cleans to nothing falls through; a broken date falls to the first time element
        (head.format('<meta name="date" content="soon"><meta name="author" content=" A ">',
                     '<h1>!!!</h1><time>x</time><time datetime="2026-01-02"><time datetime="2027-01-02">'), "Page title", "A", "2026-01-02"),
        # a title with a comment inside has no single text
        ("<title>a<!-- x -->b</title><meta property='og:title' content='Social &amp; co'>", "Social co", "", ""),
        # an unclosed h1 ends at the next block tag
        ("<h1>one<p>two", "one", "", ""),
        ("", "", "", ""),
    ]
    rows = metadata.article_metadata(pages(spark, *[c[0] for c in cases])).orderBy("page_id").collect()
    assert [(r.title, r.author, r.date) for r in rows] == [c[1:] for c in cases]
    assert rows[2].og_title == "Social co" and rows[2].og_description == ""


def test_headings_left_open(spark):
    cases = {
        "<h1>one<p>body text<div>more body</div><p>end": "one",
        "<h1>one<p>two</p></h1><p>body": "onetwo",
        "<h1>one <i>and</i> more<ul><li>x</ul><h2>two</h2>": "oneandmore",
        "<h1>one<h2>two</h2>": "one",
        "<div><h1>one<div>two</div><table><tr><td>x</table></div>": "onetwo",
        "<article><h1>one</article>tail</h1>": "one",
        "<h1>one": "one",
        "<h1><p>one</h2>two": "one",
        "<ul><li>a<li>b</ul><h1>one<li>two<li>three": "one",
        "<table><tr><td><h1>one<td>two</table>": "onetwo",
    }
    rows = metadata.article_titles(pages(spark, *cases)).orderBy("page_id").collect()
    assert [r.title for r in rows] == list(cases.values())


def test_arrays_are_computed_once(spark):
    """No filter on the size of an exploded array: it would compute the array once more."""
    raw = pages(spark, "<p>a</p>")
    for df in (tokens.html_tokens(raw), blocks.text_blocks(raw), media.page_links(raw), media.page_images(raw), tokens.meta_tags(raw)):
        nodes = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not [n for n in nodes if n.lstrip(" :+-").startswith("Filter") and "size(" in n]


def test_meta_rows_and_images(spark):
    body = (
        '<meta name="k" property="p" content="c &amp; d"><meta charset=x><script>"<img src=no>"</script><!-- <img src=no> -->'
        '<img src="a" src="b" alt="x &lt; y" width="50%" height="7"><img data-src="lazy"><img alt="none"><IMG SRC=""  data-src=z />'
    )
    table = pages(spark, body)
    assert [(r.kind, r.key, r.content) for r in tokens.meta_tags(table).orderBy("kind").collect()] == [
        ("name", "k", "c & d"), ("property", "p", "c & d"),
    ]
    images = [(r.src, r.alt, r.width, r.height) for r in media.page_images(table).orderBy("pos").collect()]
    assert images == [("b", "x < y", None, 7), ("lazy", "", None, None), ("z", "", None, None)]


def test_links(spark):
    body = '<a href="../x?y=1&amp;z">one <b>two</b></a> <a name=q>no</a><a href="#f">open<a href="mailto:a@b">m</a><a href="tel:1">t</a>'
    rows = media.page_links(pages(spark, body)).orderBy("pos").collect()
    assert [(r.text, r.abs_href, r.link_class) for r in rows] == [
        ("one two", "https://site.example/x?y=1&z", "other"), ("open", "#f", "fragment"),
        ("m", "mailto:a@b", "mailto"), ("t", "tel:1", "other"),
    ]


PAGE = """<html><head><title>T</title></head><body><nav><a href="/x">nav</a></nav></div></nav><article><h1>Head <i>it</i></h1><p>See
<a href="../r?q=1&amp;lt=2">rel &amp; it</a> <b>bold<br>x</p><ul><li>one<ul><li><p>sub</p></li></ul></li><li>two</li></ul>
<ol><li>n</li></ol><blockquote>q1<p>q2</blockquote><pre>a  b
c</pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><img src="/i.png" alt="I"><div class="x ad"><div>n</div>
ad text</div>after <mark>m</mark><footer>f</footer></article></body>"""

RENDERED = """# Head *it*

See [rel & it](../r?q=1&lt=2) **bold x**

- one
  - sub
- two
1. n

> q1

> q2

```
a  b
c
```

| A | B |
| --- | --- |
| 1 | 2 |

![I](/i.png)

after <mark>m</mark>"""


def test_render(spark):
    table = pages(spark, PAGE, "<html><body></body></html>")
    rows = blocks.render_markdown(table).orderBy("page_id").collect()
    assert [r.markdown for r in rows] == [RENDERED, ""]
    assert "![I]" not in blocks.render_markdown(table, keep_images=False).orderBy("page_id").first().markdown


def test_regions(spark):
    rows = blocks.text_blocks(pages(spark, PAGE)).collect()
    regions = {r.text: r.region for r in rows}
    assert regions["T"] == "head" and regions["nav"] == "nav" and regions["f"] == "footer"
    assert regions["n"] == "ad" and regions["ad text"] == "ad" and regions["after m"] == "article"
    # stray closing tags do not push a depth below zero
    assert regions["Head it"] == "article"


def test_density_rule(spark):
    long = "word " * 12
    body = f"<h2>kept</h2><p>{long}</p><p>short</p><h3>far</h3><p><a href=x>{long}</a></p>"
    assert [r.text for r in blocks.main_blocks(pages(spark, body)).orderBy("block_id").collect()] == ["kept", long.strip()]


@pytest.mark.parametrize("heavy", [10_000, 1])
def test_repeated_blocks(spark, monkeypatch, heavy):
    """The same result whether repeated keys are broadcast or shuffled."""
    monkeypatch.setattr(blocks, "HEAVY_KEYS", heavy)
    bodies = [f"<article><p>boiler plate</p><p>own {i}</p><p>own {i}</p></article>" for i in range(5)] + ["<article><p>boiler plate</p></article>"]
    table = pages(spark, *bodies)
    rows = blocks.main_blocks(table, max_host_repeat=3).collect()
    assert sorted(r.text for r in rows) == sorted(f"own {i}" for i in range(5) for _ in range(2))
    assert blocks.render_markdown(table, max_host_repeat=3).count() == 6


def test_no_text_is_made_of_blocks_that_no_article_holds(spark):
    odd = "<nav><ul><li>m<div><article><p>a<ul><li>b</ul><aside>s<blockquote>q</article><div class=ad>d</div><form>f</form><main><ol><li>c"
    open_page = "<header>h</header><p>p</p><form><p>f</p></form><footer>t</footer>"
    rows = spark.createDataFrame([(0, odd), (1, open_page), (2, "")], "page_id int, html string")
    wanted = (*blocks.ARTICLE_REGIONS, *blocks.OPEN_REGIONS)
    both = tokens.with_tokens(rows).select(blocks.block_array().alias("every"), blocks.block_array("tokens", wanted).alias("some"))
    found = both.collect()
    assert all(r["some"] == [b for b in r["every"] if b["region"] in wanted] for r in found)
    assert [len(r["some"]) < len(r["every"]) for r in found] == [True, True, False]
    assert [(b["region"], b["text"]) for b in found[0]["some"]] == [("article", "a"), ("article", "b"), ("form", "f"), ("main", "c")]
