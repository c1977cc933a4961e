"""The tokenizer against html.parser."""

from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tonemill.operators import html as H
from tonemill.plans import catalog


class Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.label = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.label = None
            if "href" in dict(attrs):
                self.label = []
                self.found.append((dict(attrs)["href"] or "", self.label))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "a":
            self.label = None

    def handle_data(self, data):
        if self.label is not None:
            self.label.append(data.strip())


def parsed(html):
    p = Links()
    p.feed(html)
    p.close()
    return [(href, " ".join(t for t in texts if t)) for href, texts in p.found]


PAGES = [
    '<a href="/x">one</a><A HREF=\'y?a=1&amp;b=2\' class=z>two <b> three</b>\n</A >',
    "<a href=plain>t</a><a class='x' href = spaced >u &lt; v &eacute;</a>",
    '<!-- <a href="no">no</a> --><a href="yes">yes<!-- c --></a><!doctype html><?php x ?>',
    '<script>var s = "<a href=no>no</a>";</script><style>a { content: "<a href=no>" }</style><a href="ok">ok</a>',
    '<a name="x">no href</a><a href>empty</a><a href="">blank</a>',
    '<a title="a > b" href="gt">gt</a><a href="two" href="last">dup</a>',
    '<a href="open">open <a href="next">next</a> after</a> 1 < 2 <3 <a href="end">unclosed',
    '<a\nhref="nl"\n>\n line </a><br/><a href="self"/>text</a>',
    "", "no tags", "<", "a < b > c", "<a href='é'>数字&nbsp;x</a>",
]


@pytest.mark.parametrize("html", PAGES)
def test_equals_the_library(html):
    assert [(href, label) for href, _, label in H.links_of(html, None)] == parsed(html)


def test_all_pages_equal_the_library(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = [(r.page_id, i, href, urljoin(r.url, href), label) for r in pages.collect() for i, (href, label) in enumerate(parsed(r.html))]
    got = catalog.queries()["html_links"](spark, sf)
    assert got.columns == ["page_id", "position", "href", "target", "label"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_targets(spark):
    html = '<a href="sub/a">Alba Report 2025</a><a href="//h.org/b">Bela Report 2025</a><a href="/c">Communication Report 2025</a><a href="?q">Alba  Report 2025</a><a href="http://[bad">x</a><a href="d">Other</a>'
    df = spark.createDataFrame([(1, "http://e.org/p/q", html, 0), (2, None, html, 0), (3, "http://e.org/p/q", "<base href='/r/'><base href='/s/'>" + html, 0), (4, "u", None, 0)], "page_id long, url string, html string, label int")
    links = H.page_links(df)
    got = {(r.page_id, r.position): r.target for r in links.collect()}
    assert [got[1, i] for i in range(6)] == ["http://e.org/p/sub/a", "http://h.org/b", "http://e.org/c", "http://e.org/p/q?q", None, "http://e.org/p/d"]
    assert got[2, 0] is None and got[3, 0] == "http://e.org/r/sub/a" and not any(k[0] == 4 for k in got)
    named = H.targets_by_label(links.where("page_id = 1"), r".+\s+Report 2025", r"\s+Report\s+2025", [F.col("page_id"), F.col("position")], "Communication")
    assert {(r.name, r.target) for r in named.collect()} == {("Alba", "http://e.org/p/q?q"), ("Bela", "http://h.org/b")}
    assert H.page_links(df.limit(0)).count() == 0
