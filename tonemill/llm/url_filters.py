"""URL filters by redirect equivalence, in DataFrame functions only.

Edges come from the pages themselves: `<link rel="canonical" href=...>` and `<meta http-equiv="refresh"
content="...url=...">`. Connected components over them (url to url, hashed to 64 bits, so that equal urls are one node)
carry a block from a url that a rule blocks to all its aliases. Precedence, highest first: the longest rule that fits the
url itself, allow or block; a block that reaches the url from an alias; allow. So an explicit allow is never overruled by
a propagated block, and it does not itself unblock aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import cut, maybe_broadcast
from tonemill.llm.components import components

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits. Of equally long ones the first listed."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def without_dots(path: Column) -> Column:
    """A path that begins with `/`, its `.` and `..` segments taken out."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(stack, open_end), "/"))).otherwise(path)


def resolve(target: Column, base: Column) -> Column:
    """The url that target means on a page of url base, absolute ones as they are; null if it is empty, only a fragment, of a
    scheme without `://`, or relative to a base without `://`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root, before = F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.when(path_of(base) == "", "/").otherwise(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (scheme == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(before, target))
        .when(target.startswith("/"), F.concat(root, without_dots(own), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): urls that redirect to, or name as canonical, another url, by any such tag of the page.

    Targets have `&amp;` decoded and are resolved against the page's `<base href>`, if it has one, or else its url.
    """
    decoded = lambda c: F.regexp_replace(c, r"(?i)&(amp|#38|#x26);", "&")
    inside = lambda tag, name: decoded(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1))
    every = lambda pattern, name: F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1)), lambda x: inside(x, name))
    canonical = every(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", "href")
    refresh = every(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", "url")
    own_base = inside(F.regexp_extract(F.col(html), r"(?is)(<base\b[^>]*\bhref\s*=[^>]*>)", 1), "href")
    found = pages.select(F.col(url).alias("source"), own_base.alias("own_base"), F.explode(F.concat(canonical, refresh)).alias("t"))
    base = F.coalesce(resolve(F.col("own_base"), F.col("source")), "source")
    found = found.select("source", resolve(F.col("t"), base).alias("target"))
    return found.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target"))).distinct()


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, via: one row per page.

    edges: (source, target) urls; by default those that the pages' html states. via: `rule`, `alias` or `none`.
    Null url: empty host and path, no rule, allowed. Null html has no edges; all of a long html is searched. Repeated pages get equal rows; an empty table gives an empty result;
    other columns of pages are not read.
    """
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("u")).withColumns({"host": host, "path": path})
    judged = judged.withColumns({"rule": rule, "own": verdict})
    edges = cut((links(pages, url, html) if edges is None else edges).select("source", "target"))
    if edges.isEmpty():  # the rules alone decide
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.when(F.col("own").isNotNull(), "rule").otherwise("none").alias("via"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("u")).distinct()
    blocked = ends.withColumns({"host": host, "path": path}).select(F.xxhash64("u").alias("id"), rule_of(host, path, rules)[1].alias("own")).where("own = 'block'")
    groups = components(edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    bad = groups.join(blocked, "id", "left_semi").select("component").distinct()
    reached = groups.join(bad, "component", "left_semi").select("id")
    # by the url itself, so that a clash of hashes in the graph reaches no other page; null urls, which no edge reaches, are dealt out
    reached = cut(ends.withColumn("id", F.xxhash64("u")).join(reached, "id", "left_semi").select(F.col("u").alias("alias")))
    own_key = F.coalesce("u", F.concat(F.lit("\0"), F.col("page_id").cast("string")))
    out = judged.withColumn("key", own_key).join(maybe_broadcast(reached, 100_000), F.col("key") == F.col("alias"), "left").withColumn("reached", F.col("alias").isNotNull())
    alias = F.col("own").isNull() & F.col("u").isNotNull() & F.coalesce("reached", F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(alias, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(alias, "alias").otherwise("none").alias("via"),
    )
