"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space plus the four separators C0 has; a Java character class.
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"


def strip_space(c: Column) -> Column:
    """`c` without white space of any kind at either end; null stays null."""
    return F.regexp_replace(c, rf"(?s)^{SPACE}+|{SPACE}+$", "")


def filled(c: Column) -> Column:
    """`c` without surrounding white space, null as ''."""
    return F.coalesce(strip_space(c), F.lit(""))


def missing(c: Column) -> Column:
    """True where the text is null or ''."""
    return c.isNull() | (c == "")


def or_else(c: Column, default: Column | str) -> Column:
    """`c`, or `default` where `c` is null or ''."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c, F.lit("")), default)


def let(c: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(c), use)[0]


def first_given(*columns: Column) -> Column:
    """The first text that isn't '', '' if there is none. Each is computed once, and only if those before are ''."""
    return F.coalesce(*(let(c, lambda v: F.when(v != "", v)) for c in columns), F.lit(""))
