"""Links of html pages by a tokenizer: tags, attributes of any quoting, comments, raw text and entities; targets joined to the page's url."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.session import share_package

#: A comment, another declaration or instruction, an end tag, or a start tag with all its attributes; quoted values may hold `>`.
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|</[^a-zA-Z][^>]*>?"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[\s/]+|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*))?|=)*)>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|(?!["'])[^\s>]*))?""")
#: Elements whose content is text up to their end tag.
RAW = ("script", "style")


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kind is start, end or text; text outside script and style is decoded, names are in lower case.
    Of an attribute that a tag has twice the last holds."""
    at = 0
    while at < len(html):
        found = TOKEN.search(html, at)
        if not found:
            yield "text", unescape(html[at:]), {}
            return
        if found.start() > at:
            yield "text", unescape(html[at : found.start()]), {}
        at = found.end()
        if found["end"]:
            yield "end", found["end"].lower(), {}
        elif found["start"]:
            name = found["start"].lower()
            given = ((a[1].lower(), a[2] or "") for a in ATTRIBUTE.finditer(found["attributes"]))
            yield "start", name, {k: unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in given}
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                yield "text", html[at : stop.start() if stop else len(html)], {}
                at = stop.start() if stop else len(html)


def links_of(html: str, url: str | None) -> list[tuple[str, str | None, str]]:
    """(href, target, label) of each anchor with a href, in order. The label: the texts up to the anchor's end, or to the next anchor, each
    without white space around it, joined by blanks. The target: the href joined to the page's first base, itself joined to the
    page's url; null without a url, or where it is no url."""

    def joined(base: str, href: str) -> str | None:
        try:
            return urljoin(base, href.strip())
        except ValueError:
            return None

    base, out, label = url, [], None
    seen_base = False
    for kind, name, attributes in tokens(html):
        if kind == "text" and label is not None:
            label.append(name.strip())
        elif name == "a" and kind in ("start", "end"):
            label = None
            if kind == "start" and "href" in attributes:
                label = []
                out.append((attributes["href"], label))
        elif kind == "start" and name == "base" and "href" in attributes and not seen_base:
            seen_base, base = True, joined(url, attributes["href"]) if url is not None else None
    return [(href, joined(base, href) if base is not None else None, " ".join(t for t in texts if t)) for href, texts in out]


def page_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, position, href, target, label: the links of each page. Null html has none; a narrow step, page by page."""
    share_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = links_of(batch.column(2)[row].as_py(), batch.column(1)[row].as_py())
                if found:
                    href, target, label = (pa.array(x, pa.string()) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(found), batch.column(0).type), pa.array(range(len(found)), pa.int32()), href, target, label], ["page_id", "position", "href", "target", "label"])

    kind = pages.schema[page_id].dataType.simpleString()
    some = pages.where(F.col(html).isNotNull()).select(page_id, url, html)
    return some.mapInArrow(run, f"page_id {kind}, position int, href string, target string, label string").withColumnRenamed("page_id", page_id)


def targets_by_label(links: DataFrame, pattern: str, suffix: str, order: list[Column], without: str | None = None) -> DataFrame:
    """name, target: links whose whole label matches a pattern (and does not contain `without`), by the label without a suffix; of
    several the last in the given order."""
    some = links.where(F.col("label").rlike(rf"\A(?:{pattern})\z"))
    if without is not None:
        some = some.where(~F.contains("label", F.lit(without)))
    name = F.trim(F.regexp_replace("label", rf"(?:{suffix})\z", ""))
    return some.groupBy(name.alias("name")).agg(F.max_by("target", F.struct(*order)).alias("target"))
