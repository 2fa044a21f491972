"""Text that looks the same but differs in its characters."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.pairs import hash128, self_pairs
from leadloom.sources.tables import cut

# Characters drawn alike that the public table of confusable characters leaves apart or doesn't know, and those
# that names and addresses can't do without; each group is written as its first member.
ALIKE = [
    "-‐‑‒–—―−⁃－ーｰ一", "〇○◯",
    "オ才", "タ夕", "トト卜", "ロ口", "ハ八", "ヘへ", "ベべ", "ペぺ", "ニ二", "エ工", "カ力", "ノ丿", "ヒ匕", "ム厶", "日曰",
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "HΗН", "IΙІ", "JЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥҮ", "ZΖ",
    "aа", "cсϲ", "eе", "hһ", "iі", "jј", "oοо", "pр", "sѕ", "vν", "xх", "yу",
]

#: Whole values that stand for no value.
PLACEHOLDERS = ["", "-", "なし", "無し", "無", "非公開", "不明", "未定", "未設定", "フォームのみ", "フォームより", "none", "null", "n/a", "na", "unknown"]


def _alike_table() -> dict[int, str]:
    return {ord(c): group[0] for group in ALIKE for c in group[1:] if c != group[0]}


class _Shapes(dict):
    """A translation table that learns each character when it first occurs."""

    #: Fillers and joiners that draw nothing beside the format characters and variation selectors.
    EMPTY = frozenset({0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)})

    def __missing__(self, code: int) -> str:
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if code in self.EMPTY or unicodedata.category(c) == "Cf":
            form = ""
        elif c.isspace():
            form = " "
        elif len(form) > 1 and unicodedata.decomposition(c).startswith("<") and unicodedata.decomposition(c).split(">")[0] not in ("<wide", "<narrow"):
            form = c  # a ligature of words is not drawn like the words
        self[code] = form
        return form


_SHAPES = _Shapes()


@functools.cache
def _table() -> dict[int, str]:
    return _alike_table()


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def _looks_like(c: str, shape: str) -> str:
    """The character that `c` stands for if its confusable shape is `shape`, '' if it is left as it is.

    The script rule: both are letters or both dashes, and they are of different scripts or Latin beyond ASCII, so words of
    one script stay apart. The table draws I, l and 1 alike, and O and 0: a capital stands for the capital.
    """
    if len(shape) != 1 or c == shape or c.isascii() or unicodedata.category(c)[0] != "L" or unicodedata.category(shape)[0] != "L":
        return ""
    shape = "I" if shape == "l" and c.isupper() else shape
    a, b = _script(c), _script(shape)
    return shape if a != b or a == "LATIN" and c.islower() == shape.islower() else ""


_CONFUSABLES: dict[str, dict[int, str]] = {}


def confusables(spark: SparkSession) -> dict[int, str]:
    """Look-alike characters and what they stand for: Unicode's table of confusable characters under the script rule, with ALIKE.

    The table is that of the ICU library Spark brings along; it has a few thousand entries, whatever the data.
    """
    app = spark.sparkContext.applicationId
    if app in _CONFUSABLES:
        return _CONFUSABLES[app]
    codes = [c for c in map(chr, (*range(0xA0, 0xD800), *range(0xE000, 0x20000))) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c) == c]
    checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    shapes = checker.getSkeleton("\n".join(codes)).split("\n")
    group = {ord(c): g[0] for g in ALIKE for c in g}
    table = _alike_table()
    for c, shape in zip(codes, shapes, strict=True):
        if (to := _looks_like(c, shape)) and ord(c) not in group:
            table[ord(c)] = group.get(ord(to), to)
    _CONFUSABLES[app] = table
    return table


def plain(text: str) -> str:
    """The text in composed form, of one character width, without invisible characters."""
    return unicodedata.normalize("NFC", text.translate(_SHAPES))


def one_form(text: str, alike: dict[int, str] | None = None) -> str:
    """The text in composed compatibility form without invisible characters, with plain spaces and one letter per look.

    Spaces at either end go; spaces within stay as many as they are. Letter case stays, as it can be seen. alike: the
    characters drawn like others (`confusables`); without it those of ALIKE.
    """
    text = text.translate(_SHAPES)
    if not text.isascii():  # marks join the letter that looks like theirs
        alike = _table() if alike is None else alike
        text = unicodedata.normalize("NFC", text.translate(alike)).translate(alike)
    return text.strip(" ")


_POSTCODE = re.compile(r"^[〒T]?\s*\d{3}[-ー ]?\d{4}\s*")
_LOT = re.compile(r"^[^\d\s]+\d")


def is_case(field: str, form: str) -> bool:
    """False for place-holders, phones without 10 or 11 digits, and addresses without a lot number."""
    if form.casefold() in _placeholders():
        return False
    if field == "phone":
        digits = re.sub(r"[^\d+]", "", form)
        digits = "0" + digits[3:] if digits.startswith("+81") else digits.replace("+", "")
        return len(digits) in (10, 11) and bool(digits.strip("0"))
    if field == "address":
        return bool(_LOT.match(_POSTCODE.sub("", form)))
    return True


@functools.cache
def _placeholders() -> frozenset[str]:
    return frozenset(one_form(x).casefold() for x in PLACEHOLDERS)


def _forms(batches: Iterator[pa.RecordBatch], alike: dict[int, str]) -> Iterator[pa.RecordBatch]:
    """Each batch's distinct values are brought to one form once."""
    for b in batches:
        ids = b.column(0)
        for i in range(1, b.num_columns):
            field, coded = b.schema.names[i], pc.dictionary_encode(b.column(i))
            forms = [one_form(x, alike) for x in coded.dictionary.to_pylist()]
            forms = pa.array([f if is_case(field, f) else None for f in forms], pa.string())
            look = forms.take(coded.indices)
            mask = pc.is_valid(look)
            ids_, look, value = ids.filter(mask), look.filter(mask), b.column(i).filter(mask)
            yield pa.record_batch([ids_, pa.array([field] * len(ids_), pa.string()), look, value], names=["id", "field", "look", "value"])


def looks(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, look, value): the consistent form of each value that can be a case; nulls and place-holders have no row."""
    rows = df.select(F.col(key).cast("string").alias("id"), *(F.col(f).cast("string").alias(f) for f in fields))
    return rows.mapInArrow(functools.partial(_forms, alike=confusables(df.sparkSession)), "id string, field string, look string, value string")


def _hashed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return looks(df, key, fields).select("id", "field", *hash128(F.concat_ws("\x1f", "field", "look")), F.xxhash64("value").alias("v"))


def _shared(rows: DataFrame) -> DataFrame:
    """The looks that several values have, each with the smallest id of a row that has it."""
    ends = rows.groupBy("h1", "h2").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("id").alias("class_id"))
    return ends.where("lo <> hi").select("h1", "h2", "class_id")


def look_classes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, class_id): each row whose value in a field looks like another value, with the smallest id of those that look so.

    What `look_alikes` says in pairs, one row a record and field; null ids have no row.
    """
    rows = _hashed(df, key, fields)
    return rows.where("id IS NOT NULL").join(_shared(rows), ["h1", "h2"]).select("id", "field", "class_id").distinct()


def look_alikes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b, field): rows whose values in a field look the same but are not the same string; id_a < id_b.

    Equal strings never meet: the distinct values of a look are counted first (combined before the exchange), only looks
    with two values or more go on, their values pair, and the pairs are then given their rows.
    """
    rows = _hashed(df, key, fields)
    kept = cut(rows.join(_shared(rows), ["h1", "h2"], "left_semi"))
    values = kept.select("h1", "h2", "v").distinct()
    pairs = values.alias("a").join(values.alias("b"), ["h1", "h2"]).where("a.v < b.v").select("h1", "h2", F.col("a.v").alias("va"), F.col("b.v").alias("vb"))
    left = kept.select("h1", "h2", "field", F.col("id").alias("x"), F.col("v").alias("va"))
    right = kept.select("h1", "h2", F.col("id").alias("y"), F.col("v").alias("vb"))
    met = pairs.join(left, ["h1", "h2", "va"]).join(right, ["h1", "h2", "vb"]).where("x <> y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "field").distinct()


__all__ = ["look_alikes", "looks", "one_form", "self_pairs"]
