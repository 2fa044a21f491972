"""Text of HTML as expressions. Null gives ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"[\s\x{3000}\x{A0}]+"


def _replace(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, *r), rules, F.coalesce(c, F.lit("")))


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def visible_text(html: Column) -> Column:
    """The text a reader sees: no scripts, styles, templates and tags, five entities decoded, spaces collapsed. [TX-01]"""
    bare = _replace(html, (r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", ""), (r"(?s)<[^>]+>", " "))
    return _tidy(_replace(bare, ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')))


def short_text(html: Column, most: int) -> Column:
    """Text without scripts, styles and tags, cut to `most` characters. [TX-02]"""
    return F.substring(_tidy(_replace(html, (r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), (r"(?s)<[^>]+>", " "))), 1, most)


def title(html: Column) -> Column:
    """The document's title with six entities decoded; '' if it has none. [TX-04]"""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _tidy(_replace(raw, ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")))


def headings(html: Column, most: int = 3) -> Column:
    """The first non-empty headings of the two upper levels, joined with ' / '. [TX-03]"""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[12]\b[^>]*>(.*?)</h[12]>"), F.lit(1))
    texts = F.filter(F.transform(found, lambda h: _tidy(F.regexp_replace(h, r"<[^>]+>", " "))), lambda t: t != "")
    return F.array_join(F.slice(texts, 1, most), " / ")


def form_text(html: Column, before: int = 1500, after: int = 2500, most: int = 2700) -> Column:
    """Headings, then the text around the first form (of the whole page where there is none). [TX-03]"""
    h = F.coalesce(html, F.lit(""))
    at = F.instr(F.lower(h), "<form")
    start = F.greatest(F.lit(1), at - before)
    part = F.when(at > 0, F.substring(h, start, at + after - start)).otherwise(h)
    body = F.substring(visible_text(part), 1, most)
    return F.when(headings(h) != "", F.concat(headings(h), F.lit("\n"), body)).otherwise(body)


def og_type(html: Column) -> Column:
    """The page's declared kind, in either order of the attributes, in lower case. [TX-12]"""
    h = F.coalesce(html, F.lit(""))
    a = F.regexp_extract(h, r"""(?i)<meta[^>]+property=["']og:type["'][^>]+content=["']([^"']+)["']""", 1)
    b = F.regexp_extract(h, r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:type["']""", 1)
    return F.lower(F.when(a != "", a).otherwise(b))


def refresh_target(html: Column) -> Column:
    """Where a meta refresh leads, '' if the page has none. [TX-11]"""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]*content=["'][^"'>]*url=\s*['"]?([^"'>\s]+)""", 1))


def base_href(html: Column) -> Column:
    """The address relative links start from, if the page names one. [UR-08]"""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<base[^>]+href=["']([^"']+)["']""", 1)


def canonical_href(html: Column) -> Column:
    """The page's canonical address, in either order of the attributes. [UR-08]"""
    h = F.coalesce(html, F.lit(""))
    a = F.regexp_extract(h, r"""(?i)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)["']""", 1)
    return F.when(a != "", a).otherwise(F.regexp_extract(h, r"""(?i)<link[^>]+href=["']([^"']+)["'][^>]+rel=["']canonical["']""", 1))


def rendered_by_script(html: Column) -> Column:
    """Whether the page is a shell that scripts fill. [TX-15]"""
    marks = (
        r"""__NEXT_DATA__|__NUXT__|_nuxt/|window\.__INITIAL_STATE__|<div id="(?:app|__next)"></div>|window\.__gatsby|___gatsby|<div id="gatsby-focus-wrapper"|remixContext|"""
        r"""window\.__remixContext|<astro-island|ng-version=|<app-root[\s>]|window\.angular|data-page=["']\{.*"component\""""
    )
    return F.coalesce(html, F.lit("")).rlike(marks)


# Marks of site builders.
BUILDERS = {
    "shopify": r"cdn\.shopify\.com|shopify\.com/s/files",
    "wordpress": r"wp-content/|wp-includes/|xmlrpc\.php",
    "jimdo": r"jimdo\.com|jimdofree\.com|jimdosite\.com",
    "wix": r"wix\.com|static\.parastorage\.com|wixstatic\.com",
    "squarespace": r"squarespace\.com|static1\.squarespace\.com",
    "studio": r"studio\.design|studiocdn\.com",
    "stores": r"assets\.stores\.jp|stores\.jp/(?:shop|assets)|itembox-assets\.com|thebase\.in/lib|base\.shop",
}


def builder(html: Column) -> Column:
    """The site builder a page was made with, '' if none is known. [TX-15]"""
    h = F.coalesce(html, F.lit(""))
    return reduce(lambda rest, x: F.when(h.rlike(x[1]), F.lit(x[0])).otherwise(rest), reversed(BUILDERS.items()), F.lit(""))
