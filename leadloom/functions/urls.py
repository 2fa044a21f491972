"""URL expressions. Everything is a Column, so it stays in generated code; no expression raises on malformed input.

Common shape: an address has a scheme, an authority, a path and a query. Where a text has no scheme and authority, the
function says what it gives instead. Null gives ''.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import lists
from leadloom.functions.text import let

_HEAD = r"(?s)^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?"


def _text(c: Column) -> Column:
    """The text as an address parser reads it: no control characters and spaces at the ends, no tabs and line ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def encoded(c: Column) -> Column:
    """Spaces and characters beyond ASCII percent-encoded."""
    one = lambda x: F.when(x.rlike(r"[^\x21-\x7E]"), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", r"%$1")).otherwise(x)
    return F.when(c.rlike(r"[^\x21-\x7E]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def host(c: Column) -> Column:
    """The host in lower case without port and user; '' where there is none."""
    return F.lower(F.regexp_extract(_text(c), _HEAD + r"([^/?#:\s]+)", 1))


def host_key(c: Column, fallback: Column | None = None) -> Column:
    """The host without a leading www.; `fallback` (default '') where there is none. [UR-03]"""
    found = F.regexp_replace(host(c), r"^www\.", "")
    return F.when(found != "", found).otherwise(F.lit("") if fallback is None else fallback)


def raw_host(c: Column) -> Column:
    """The authority as written, with port and case, for http addresses only, without a leading www. [UR-04]"""
    return F.regexp_replace(F.regexp_extract(_text(c), r"^https?://([^/?#]+)", 1), r"^www\.", "")


def path(c: Column) -> Column:
    """The path, '' at the root without slash and where there is no host."""
    return F.regexp_extract(_text(c), _HEAD + r"[^/?#]+([^?#]*)", 1)


def query(c: Column) -> Column:
    """What follows the first question mark, without the fragment."""
    return F.regexp_extract(_text(c), r"(?s)^[^?#]*\?([^#]*)", 1)


def kept_query(c: Column, dropped: list[str], any_case: bool = False, as_written: bool = False) -> Column:
    """'?' and the parameters whose names aren't in `dropped`; '' if none is left. as_written: a query without any of them stays as it is."""

    def goes(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        return (F.lower(name) if any_case else name).isin(dropped)

    params = F.split(query(c), "&")
    kept = F.array_join(F.filter(params, lambda p: (p != "") & ~goes(p)), "&")
    if as_written:
        kept = F.when(F.exists(params, goes), kept).otherwise(query(c))
    return F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))


def store_key(c: Column) -> Column:
    """The key under which the store knows a page: host and path in lower case, without www., final and repeated slashes,
    tracking parameters, port, user and fragment; text that is no address in lower case without spaces around. [UR-01]"""
    u = F.regexp_replace(_text(c), r"(?i)&amp;", "&")
    plain = F.regexp_replace(F.regexp_replace(path(u), r"/+$", ""), r"/{2,}", "/")
    key = F.regexp_replace(F.lower(F.concat(host(u), encoded(plain), encoded(kept_query(u, lists.STORE_KEY_PARAMS, any_case=True, as_written=True)))), r"^www\.", "")
    return F.when(host(u) != "", key).otherwise(F.trim(F.lower(u)))


def page_key(c: Column) -> Column:
    """scheme://host/path without one final slash, query and fragment; the text itself if it is no address. [UR-02]"""
    u = _text(c)
    scheme = F.lower(F.regexp_extract(u, r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    return F.when(host(u) != "", F.concat(scheme, F.lit("://"), host(u), F.regexp_replace(path(u), "/$", ""))).otherwise(u)


def without_tracking(c: Column) -> Column:
    """The address without tracking parameters; everything else stays as written. [UR-05]"""
    u = _text(c)
    base, fragment = F.regexp_extract(u, r"(?s)^([^?#]*)", 1), F.regexp_extract(u, r"(?s)(#.*)$", 1)
    return F.when(host(u) != "", F.concat(base, kept_query(u, lists.STRIP_PARAMS), fragment)).otherwise(u)


def link_key(c: Column) -> Column:
    """The key by which links of a page are compared: without scheme, www., one final slash and tracking parameters. [UR-06]"""
    u = _text(c)
    key = F.lower(F.concat(host(u), F.regexp_replace(path(u), "/$", ""), kept_query(u, lists.LINK_KEY_PARAMS)))
    bare = F.regexp_replace(F.regexp_replace(F.lower(u), "/$", ""), r"^https?://", "")
    return F.regexp_replace(F.when(host(u) != "", key).otherwise(bare), r"^www\.", "")


def is_internal(link: Column, base: Column) -> Column:
    """Whether a link's host is the base's or a sub-domain of it. [UR-09]"""
    a, b = host_key(link), host_key(base)
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b))


def contact_subdomain(c: Column) -> Column:
    """Whether the host's first label speaks of contact. [UR-10]"""
    return F.split(host(c), r"\.")[0].isin("contact", "inquiry", "form", "mail", "toiawase", "otoiawase")


def same_page(a: Column, b: Column) -> Column:
    """Whether two addresses agree in origin and path, but for a final slash and case. [UR-11]"""
    return F.lower(page_key(a)) == F.lower(page_key(b))


def is_line(c: Column) -> Column:
    """Whether the address opens a chat of the messenger whose links stand for a contact form. [UR-12]"""
    return _text(c).rlike(lists.LINE_URL)


def decoded(c: Column) -> Column:
    """The percent-decoded text; null where the bytes are no UTF-8. [UR-13]"""
    out = F.try_url_decode(F.replace(_text(c), F.lit("+"), F.lit("%2B")))
    return F.when(~F.contains(out, F.lit("�")), out)


def fetchable(c: Column) -> Column:
    """Whether the text starts like an address that can be fetched. [UR-14]"""
    return F.startswith(_text(c), F.lit("http"))


def tried_path(c: Column) -> Column:
    """The path in lower case without one final slash, to see whether it was tried. [UR-15]"""
    return F.regexp_replace(F.lower(path(c)), "/$", "")


def display(c: Column) -> Column:
    """Host and path for a table cell: no www., no final slash, the path cut to 20 characters; 35 of what is no address. [UR-16]"""
    u = _text(c)
    p = F.regexp_replace(path(u), "/+$", "")
    short = F.when(F.length(p) > 20, F.concat(F.substring(p, 1, 20), F.lit("…"))).otherwise(p)
    return F.when(host(u) != "", F.concat(host_key(u), short)).otherwise(F.substring(F.regexp_replace(u, r"^https?://", ""), 1, 35))


def _either(texts: list[str]) -> str:
    return "|".join(re.sub(r"([^\w ])", r"\\\1", t) for t in texts)


def on_hosts(c: Column, hosts: list[str]) -> Column:
    """Whether a host is one of `hosts` or a sub-domain of one. [FL-16, FL-19]"""
    return c.rlike(rf"(?:^|\.)(?:{_either(hosts)})$")


def holds_host(c: Column, hosts: list[str]) -> Column:
    """Whether a host contains one of `hosts` anywhere. [FL-18, FL-20]"""
    return c.rlike(_either(hosts))


def holds_any(c: Column, words: list[str]) -> Column:
    """Whether a lower-case text contains one of the words."""
    return c.rlike(_either([w.lower() for w in words]))


def count_of(c: Column, words: list[str]) -> Column:
    """How many of the words a lower-case text contains."""
    return let(c, lambda t: sum((F.contains(t, F.lit(w.lower())).cast("int") for w in words), F.lit(0)))
