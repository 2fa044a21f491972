"""The same postal address written differently."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.looks import plain
from leadloom.llm.pairs import Rarity, hash64, sketch
from leadloom.llm.readings import PREFECTURES, read_place, read_town
from leadloom.sources.tables import cut


class Place(NamedTuple):
    """A parsed address. lot: its numbers joined by '-'; the readings fall back to the text."""

    pref: str
    city: str
    town: str
    lot: str
    city_read: str
    town_read: str


NOWHERE = Place("", "", "", "", "", "")

_DASHES = re.compile(r"[‐‑‒–—―−⁃－ーｰ〜~]")
_DIGITS = {c: n for n, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
_UNITS = {"十": 10, "百": 100, "千": 1000}
_NUMBER = r"(?:\d+|[〇零一二三四五六七八九十百千]+)"
_LABEL = re.compile(r"^\s*(?:住所|所在地|本社|本店|address)\s*[:：]?\s*", re.I)
_POSTCODE = re.compile(r"〒?\s*(?<!\d)\d{3}-?\d{4}(?![\d-])\s*|〒\s*")
_PREFS = re.compile("|".join(PREFECTURES))
_CITY = re.compile(r"^\s*([^\d\s()]+?[市区町村](?:(?<=[町村])市)?)")
_START = re.compile(rf"\d|{_NUMBER}\s*(?:丁目|番(?!町)|号)|[〇零一二三四五六七八九十百千]+(?=[-の])")
_STEP = re.compile(rf"\s*({_NUMBER})\s*(丁目?|番地?\s*の?|号|[-のノ之])?(?:\s*の(?={_NUMBER}))?")
_NAME = re.compile(r"[一-鿿々〆ぁ-ゖァ-ヶー]{2,}")
_READ = {v: k for k, v in PREFECTURES.items()}
_KINDS = {"shi": "市", "ku": "区", "machi": "町", "cho": "町", "mura": "村", "son": "村"}


def number(text: str) -> int:
    """The value of digits or of a number in kanji, by units (五十九) or by places (三二六)."""
    if text.isdigit():
        return int(text)
    if not any(c in _UNITS for c in text):
        return int("".join(str(_DIGITS[c]) for c in text))
    total, held = 0, 0
    for c in text:
        if c in _UNITS:
            total += max(held, 1) * _UNITS[c]
            held = 0
        else:
            held = held * 10 + _DIGITS[c]
    return total + held


def lot_of(text: str) -> list[int]:
    """The numbers a text begins with, such as block, number and house; what follows belongs to a building."""
    out, at = [], 0
    while m := _STEP.match(text, at):
        after = text[m.end() :].lstrip()
        if out and not m[2] and re.match(r"\s*(?:階|F\b|f\b|室)", text[m.end(1) :]):
            break
        out.append(number(m[1]))
        at = m.end()
        if not m[2] or m[2] == "号" and not after.startswith("の"):
            break
    return out


def town_form(text: str) -> str:
    """A town's name with one way to write the small syllables, without the word for a section."""
    text = re.sub(r"\s", "", text)
    text = re.sub(r"^(?:大字|字)", "", text)
    text = re.sub(r"(?<=.)[ヶケがヵカガ](?=[一-鿿])", "が", text)
    text = re.sub(r"(?<=.)[ノの之乃](?=[一-鿿])", "の", text)
    return re.sub(r"(?<=.)のうち$|(?<=.)ノウチ$", "の内", text)


def _romaji(text: str) -> Place:
    m = re.search(r"\d+(?:-\d+)+", text)
    lot = [int(x) for x in re.findall(r"\d+", m[0])] if m else []
    words = re.findall(r"[a-z]+(?:-[a-z]+)?", text.lower())
    cities = [w for w in words if "-" in w and w.rsplit("-", 1)[1] in _KINDS]
    rest = [w for w in words if w not in cities and w != "japan"]
    prefs = [w for w in rest if w in _READ]
    towns = [w for w in rest if w not in prefs]
    if not lot or not cities and not towns:
        return NOWHERE
    city, kind = cities[0].rsplit("-", 1) if cities else ("", "")
    return Place(_READ[prefs[-1]] if prefs else "", "", "", "-".join(map(str, lot)), city + _KINDS[kind] if city else "", towns[0] if towns else "")


def parse(text: str | None) -> Place:
    """The parts of an address; municipality or town may be missing.

    NOWHERE where both are, or where there is no full lot number (two numbers at least).
    """
    if not text:
        return NOWHERE
    text = _DASHES.sub("-", _LABEL.sub("", plain(text)))
    text = re.sub(r"(?<=\d)一(?=\d)", "-", text)
    text = _POSTCODE.sub(" ", text, count=1).strip() if _POSTCODE.match(text) or "〒" in text else text.strip()
    if re.search(r"[A-Za-z]{3,}-[A-Za-z]{2,}", text) and not re.search("[市区町村]", text):
        return _romaji(text)
    m = re.match(r"^(.*?)\s*\(([^()]*[都道府県市区町村])\)\s*(.*)$", text)
    if m:
        text = f"{m[2]}{m[1]} {m[3]}"
    pref = ""
    if m := _PREFS.search(text):
        pref, text = m[0], text[m.end() :]
    m = _CITY.match(text) or re.search(r"[、,]\s*([^\d\s()、,]+?[市区町村])", text)
    city, rest = (m[1], text[m.end() :]) if m else ("", text)
    m = _START.search(rest)
    if not m:
        return NOWHERE
    town, lot = town_form(rest[: m.start()]), lot_of(rest[m.start() :])
    if city and not town and city[-1] in "町村":  # a town without its municipality
        city, town = "", town_form(city)
    if len(lot) < 2 or not city and not _NAME.fullmatch(town):
        return NOWHERE
    read = read_place(city[:-1])
    return Place(pref, city, town, "-".join(map(str, lot)), read + city[-1] if read else city, read_town(town) or town)


#: Characters that tell towns apart: two names that differ in these are two towns.
_TELLING = set("東西南北上中下前後新元本内外大小一二三四五六七八九十")


def _one_slip(a: str, b: str) -> bool:
    """Names of one length with one character in place of another that isn't a telling one."""
    if len(a) != len(b) or len(a) < 2:
        return False
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return len(diff) == 1 and not (diff[0][0] in _TELLING and diff[0][1] in _TELLING)


def _known(text: str, read: str) -> bool:
    return read != text


def _alike(a: str, a_read: str, b: str, b_read: str) -> float:
    """How alike two names are: 1 the same, less by the share of one slip, 0 different. A slip counts only if one of them can't be read."""
    if a_read == b_read:
        return 1.0
    if a and b and not (_known(a, a_read) and _known(b, b_read)) and _one_slip(a, b):
        return 1 - 1 / len(a)
    return 0.0


def parts(p: Place) -> dict[str, str]:
    """The parts an address gives."""
    return {k: v for k, v in (("pref", p.pref), ("city", p.city_read), ("town", p.town_read), ("lot", p.lot)) if v}


def part(kind: str, value: str) -> int:
    """The token of a part, whose rarity is what the part weighs."""
    return hash64(f"{kind}={value}")


def tokens(p: Place) -> list[int]:
    """What an address is found by: its lot number joined with its municipality and with its town, of those it gives."""
    return [hash64(f"{kind}|{read}|{p.lot}") for kind, read in (("c", p.city_read), ("t", p.town_read)) if read and p.lot]


def prefix(p: Place, rarity: Rarity, share: float) -> list[int]:
    """The rarest tokens of an address; those left out weigh less than `share` of all together."""
    found = sorted(tokens(p), key=lambda t: (-rarity.weight(t), t))
    whole, rest = sum(map(rarity.weight, found)), 0.0
    while len(found) > 1 and rest + rarity.weight(found[-1]) < share * whole:
        rest += rarity.weight(found.pop())
    return found


def containment(a: Place, b: Place, rarity: Rarity | None = None, share: float = 0.3) -> float:
    """How much of the address with fewer parts lies in the other, by the rarity of its parts; 0 if a part contradicts.

    Lot numbers are equal. A part the fuller address lacks isn't contained. Of the tokens, `share` of the weight is common.
    Without `rarity` all weigh the same.
    """
    if not a.lot or a.lot != b.lot or a.pref and b.pref and a.pref != b.pref:
        return 0.0
    lean, full = (a, b) if len(parts(a)) <= len(parts(b)) else (b, a)
    weight = rarity.weight if rarity else lambda _: 1.0
    alike = {"pref": 1.0, "lot": 1.0}
    for kind, pair in (("city", (lean.city, lean.city_read, full.city, full.city_read)), ("town", (lean.town, lean.town_read, full.town, full.town_read))):
        alike[kind] = _alike(*pair) if pair[1] and pair[3] else 1.0
        if not alike[kind]:
            return 0.0
    found, there = tokens(lean), set(tokens(full))
    if sum(weight(t) for t in found if t in there) < share * sum(map(weight, found)) or there.isdisjoint(found):
        return 0.0
    given, held = {k: weight(part(k, v)) for k, v in parts(lean).items()}, parts(full)
    return sum(w * alike[k] for k, w in given.items() if k in held) / sum(given.values())


def same_place(a: Place, b: Place, rarity: Rarity | None = None, least: float = 0.75, share: float = 0.3) -> bool:
    """Whether one address is contained in the other: `least` of its weight, so two slips are too many."""
    return containment(a, b, rarity, share) >= least


_PARTS = "pref string, city string, town string, lot string, city_read string, town_read string"


def parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pref, city, town, lot, city_read, town_read) of the addresses that have a full lot number; each distinct text is parsed once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pc.dictionary_encode(b.column(1))
            places = [parse(x) for x in coded.dictionary.to_pylist()]
            good = pa.array([bool(p.lot) for p in places], pa.bool_()).take(coded.indices)
            at = coded.indices.filter(good)
            columns = [pa.array([p[i] for p in places], pa.string()).take(at) for i in range(6)]
            yield pa.record_batch([b.column(0).filter(good), *columns], names=[key, *Place._fields])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {kind}, {_PARTS}")


_COLUMNS = list(Place._fields)


def _with_tokens(places: DataFrame, how) -> DataFrame:
    """(the columns, token): the rows of places, once for each token that `how` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [b.schema.get_field_index(c) for c in _COLUMNS]
            lists = [how(Place(*p)) for p in zip(*(b.column(i).to_pylist() for i in at))]
            rows = b.take(pa.array([i for i, x in enumerate(lists) for _ in x], pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array([t for x in lists for t in x], pa.int64())], names=[*b.schema.names, "token"])

    return places.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema) + ", token bigint")


def _places(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(_COLUMNS).distinct().withColumn(name, F.xxhash64(*_COLUMNS))


def same_places(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, least: float = 0.75, share: float = 0.3) -> DataFrame:
    """(left_key, right_key): records at the same place. Null, empty and incomplete addresses are at no place.

    A set-containment join for missing parts. How common each token is (its lot number joined with the municipality, or
    with the town) is counted over the distinct places of the left side. The places of the right side are indexed by
    their rarest tokens, those left out weighing less than `share`; the left side's places probe with all of theirs.
    Where a left place is the one with fewer parts, it is found by any of its tokens. Verified are the weight of the
    common tokens (`share`), the weighted containment of the parts (`least`) and that no part contradicts. An address
    without a municipality or a town that lies in several places denotes none of them. A place many records share is one
    posting.
    """
    a, b = cut(parsed(left, left_key, left_text)), cut(parsed(right, right_key, right_text))
    xs, ys = cut(_places(a, "x")), _places(b, "y")
    rarity = Rarity(sketch(_with_tokens(xs, lambda p: [*tokens(p), *(part(k, v) for k, v in parts(p).items())])), xs.count())
    pack = lambda d, name: d.select("token", name, F.struct(*_COLUMNS).alias(f"p_{name}"))
    probing = pack(_with_tokens(xs, tokens), "x")
    lean = pack(_with_tokens(xs.where("city_read = '' OR town_read = ''"), tokens), "x")
    met = probing.join(pack(_with_tokens(ys, lambda p: prefix(p, rarity, share)), "y"), "token").unionAll(lean.join(pack(_with_tokens(ys, tokens), "y"), "token"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (p, q) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                p, q = Place(**p), Place(**q)
                if same_place(p, q, rarity, least, share):
                    there = lambda z: bool(z.city_read) + bool(z.town_read)
                    out.append((i, "" if there(p) == there(q) else "x" if there(p) < there(q) else "y", "|".join((p.pref or q.pref, p.city_read or q.city_read, p.town_read or q.town_read))))
            at, lean, where = zip(*out) if out else [()] * 3
            at = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(lean, pa.string()), pa.array(where, pa.string())], names=["x", "y", "lean", "place"])

    agreed = cut(met.select("x", "p_x", "y", "p_y").mapInArrow(verify, "x bigint, y bigint, lean string, place string").distinct())
    who = F.struct("lean", F.when(F.col("lean") == "x", F.col("x")).otherwise(F.col("y")))
    unsure = agreed.where("lean <> ''").withColumn("who", who)
    one = unsure.groupBy("who").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low = high").select("who")
    sure = agreed.where("lean = ''").select("x", "y").unionAll(unsure.join(one, "who", "left_semi").select("x", "y"))
    left_rows = a.select(left_key, F.xxhash64(*_COLUMNS).alias("x"))
    right_rows = b.select(right_key, F.xxhash64(*_COLUMNS).alias("y"))
    return sure.join(left_rows, "x").join(right_rows, "y").select(left_key, right_key).distinct()


__all__ = ["Place", "number", "parse", "parsed", "same_place", "same_places"]
