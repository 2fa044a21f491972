"""E-mail addresses, phone numbers and postal addresses in text or HTML. '' where nothing is found; null gives ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import lists
from leadloom.functions.text import first_given, let, or_else

#: What a hidden address has after its name: it is looked for first, as it is rarer than what may be a name.
_HIDDEN_TAIL = r"(?i)(?:\[at\]|\(at\)|【at】|＠|\sat\s|@)\s*[a-zA-Z0-9.\-]{2,}\.[a-zA-Z]{2,6}"


def _first(found: Column) -> Column:
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _for_contact(found: Column) -> Column:
    """The first address meant for contact, else the first."""
    return let(found, lambda all_: first_given(_first(F.filter(all_, lambda e: F.substring_index(e, "@", 1).rlike(lists.CONTACT_LOCAL))), _first(all_)))


def email(html: Column) -> Column:
    """The e-mail address of a page: linked ones first, those meant for contact before others, then plain text, then
    addresses written with [at] and the like if there is no other. [CX-01]"""
    h = F.coalesce(html, F.lit(""))

    none = F.lit("")

    def in_text(text: Column) -> Column:
        plain = _for_contact(F.filter(_all(text, lists.PLAIN_MAIL, 0), lambda e: ~e.rlike(r"\.(js|css|png|jpg)$")))
        parts = F.array(F.regexp_extract(text, lists.HIDDEN_MAIL, 1), F.regexp_extract(text, lists.HIDDEN_MAIL, 2))
        hidden = let(parts, lambda p: F.when(p[0] != "", F.regexp_replace(F.concat_ws("@", p), r"\s+", "")).otherwise(""))
        hidden = let(hidden, lambda x: F.when(x.rlike(r"\.(js|css|png)$"), "").otherwise(x))
        return first_given(F.when(F.contains(text, F.lit("@")), plain).otherwise(none), F.when(text.rlike(_HIDDEN_TAIL), hidden).otherwise(none))

    linked = F.when(h.rlike("(?i)mailto:"), _for_contact(_all(h, rf"(?i)mailto:({lists.MAIL})", 1))).otherwise(none)
    bare = F.when(F.contains(h, F.lit("<")), F.regexp_replace(h, r"<[^>]+>", " ")).otherwise(h)
    return let(linked, lambda x: F.when(x != "", x).otherwise(let(bare, in_text)))


def first_email(html: Column) -> Column:
    """The linked address, else the first in the text unless it is no real sender. [CX-02]"""
    h = F.coalesce(html, F.lit(""))
    linked, plain = F.regexp_extract(h, rf"(?i)mailto:({lists.MAIL})", 1), F.regexp_extract(h, rf"(?i)({lists.MAIL})", 1)
    sender = let(plain, lambda p: F.when(p.rlike("(?i)noreply|no-reply|example|test"), "").otherwise(p))
    return F.when(F.contains(h, F.lit("@")), first_given(linked, sender)).otherwise(F.lit(""))


def half_width(c: Column) -> Column:
    """Digits, brackets and hyphens of phone numbers in half width. [TX-07]"""
    return F.translate(F.coalesce(c, F.lit("")), "０１２３４５６７８９（）－", "0123456789()-")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def fax_numbers(html: Column) -> Column:
    """The digits of all numbers that a fax label precedes. [CX-04]"""
    return _fax(half_width(html))


def _fax(h: Column) -> Column:
    return F.transform(_all(h, rf"{lists.FAX_LABEL}({lists.DASHED_PHONE}|0[0-9]{{9,10}})", 1), _digits)


def _tidy_phone(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, "（）－–—", "()---"), r"\s+", ""))


def phone(html: Column) -> Column:
    """The phone number of a page: a tel link, a labelled number, any number with hyphens or brackets, bare digits, +81.

    It has 10 or 11 digits with a leading 0 and is no fax number, or starts with +81. [CX-03]
    """
    label = lists.PHONE_LABEL
    tries = [r"(?i)tel:([\d\-+\s()]{7,20})", rf"{label}({lists.DASHED_PHONE})", rf"{label}(0[0-9]{{9,10}})", rf"({lists.DASHED_PHONE})", r"(0[0-9]{9,10})", r"(\+81[-\s\d]{8,16})"]

    def of(h: Column) -> Column:
        found = _tidy_phone(first_given(*(F.regexp_extract(h, p, 1) for p in tries)))
        good = lambda t: (_digits(t).rlike("^0[0-9]{9,10}$") & ~F.array_contains(_fax(h), _digits(t))) | F.startswith(t, F.lit("+81"))
        return let(found, lambda t: F.when((t != "") & good(t), t).otherwise(""))

    return let(half_width(html), of)


def first_phone(html: Column) -> Column:
    """A tel link or the first number of at least 10 digits by its pattern. [CX-05]"""
    h = F.coalesce(html, F.lit(""))
    out = F.lit("")
    for pattern in (r"(\d{2,4}[-\s]?\d{2,4}[-\s]?\d{3,4})", r"(?i)tel:([0-9\-+\s()]{10,15})"):
        found = F.regexp_replace(F.regexp_extract(h, pattern, 1), r"\s", "")
        out = F.when(F.length(F.regexp_replace(found, "[-+()]", "")) >= 10, found).otherwise(out)
    return out


def postal_address(html: Column) -> Column:
    """The address in running text: after a postal code, else after a label, else from a prefecture on; 100 characters at most. [CX-06]"""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"[\s\x{3000}]+", " "))
    def of(h: Column) -> Column:
        code = F.regexp_extract(h, lists.CODED_ADDRESS, 1)
        with_code = F.when(F.contains(h, F.lit("〒")), let(code, lambda c: F.when(c != "", F.concat(F.lit("〒"), F.replace(c, F.lit("－"), F.lit("-")), F.lit(" "), tidy(F.regexp_extract(h, lists.CODED_ADDRESS, 2)))).otherwise("")))
        return F.substring(first_given(F.coalesce(with_code, F.lit("")), tidy(F.regexp_extract(h, lists.LABELLED_ADDRESS, 1)), tidy(F.regexp_extract(h, lists.BARE_ADDRESS, 1))), 1, 100)

    return let(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", " "), r"\n+", " "), of)


def _item(h: Column, name: str) -> Column:
    """The text right after a tag with that itemprop, '' if there is none."""
    return _trim(F.regexp_extract(h, rf"""(?i)itemprop=["']{name}["'][^>]*>([^<]+)<""", 1))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$", "")


def item_phone(html: Column) -> Column:
    """The phone number of a page's microdata, if it has 10 or 11 digits with a leading 0. [CX-03]"""
    h = F.coalesce(html, F.lit(""))
    before = F.regexp_extract(h, r"""(?i)>([^<]+)<[^>]+itemprop=["']telephone["']""", 1)
    after = F.regexp_extract(h, r"""(?i)itemprop=["']telephone["'][^>]*>([^<]+)<""", 1)
    found = let(_trim(first_given(after, before)), lambda t: F.when(_digits(t).rlike("^0[0-9]{9,10}$"), t).otherwise(""))
    return F.when(h.rlike("(?i)itemprop"), found).otherwise(F.lit(""))


def item_address(html: Column) -> Column:
    """The address of a page's microdata: a flat one, else two of its parts or more. [CX-06]"""
    h = F.coalesce(html, F.lit(""))
    flat = F.regexp_extract(h, r"""(?i)itemprop=["']address["'][^>]*>([^<]{5,120})<""", 1)
    code = let(_item(h, "postalCode"), lambda c: F.when(c != "", F.concat(F.lit("〒"), F.regexp_replace(c, "^〒", ""))).otherwise(""))
    parts = F.filter(F.array(code, *(_item(h, n) for n in ("addressRegion", "addressLocality", "streetAddress"))), lambda x: x != "")
    joined = let(parts, lambda p: F.when(F.size(p) >= 2, F.array_join(p, " ")).otherwise(""))
    found = let(flat, lambda f: F.when(f != "", _trim(F.regexp_replace(f, r"[\s\x{3000}\x{A0}]+", " "))).otherwise(joined))
    return F.when(h.rlike("(?i)itemprop"), found).otherwise(F.lit(""))


def page_phone(html: Column, structured: Column) -> Column:
    """The phone number of a page's structured data, else of its text. [CX-03]

    structured: the number JSON-LD gives. A structured number that is none leaves the page without one.
    """
    tidy = F.regexp_replace(F.translate(first_given(F.coalesce(structured, F.lit("")), item_phone(html)), "（）－–—", "()---"), r"[\s\x{3000}\x{A0}]+", "")
    good = lambda t: _digits(t).rlike("^0[0-9]{9,10}$") | F.startswith(t, F.lit("+81"))
    return let(tidy, lambda t: F.when(t == "", phone(html)).when(good(t), t).otherwise(""))


def merged(of_form: Column, of_home: Column, only_gaps: bool = False) -> Column:
    """A value of the form's page before the home page's; with `only_gaps` the other way round. [CX-08]"""
    return or_else(of_home, F.coalesce(of_form, F.lit(""))) if only_gaps else or_else(of_form, F.coalesce(of_home, F.lit("")))
