"""The best values of each group of duplicate records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import strip_space

# Endings of image files.
IMAGES = ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico", "avif", "tif", "tiff"]


def instant(c: Column) -> Column:
    """`c` as microseconds since 1970; text without a zone is Tokyo time; null where it is no time."""
    t = F.regexp_replace(strip_space(c), "[/.](?=\\d{1,2}[/. T])", "-")
    t = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t)
    zoned = t.rlike(r"(?i)(Z|UTC|GMT|[+-]\d{1,2}:?\d{2})$") & t.rlike(r":\d")
    return F.unix_micros(F.when(zoned, t).otherwise(F.concat(t, F.lit("+09:00"))).try_cast("timestamp"))


def usable_phone(c: Column) -> Column:
    """10 or 11 digits of any width, not all 0; a leading +81 stands for one 0."""
    plain = F.translate(c, "０１２３４５６７８９＋", "0123456789+")
    signs = F.regexp_replace(plain, r"[^0-9+]", "")
    digits = F.regexp_replace(F.regexp_replace(signs, r"^\+81", "0"), r"\+", "")
    return digits.rlike(r"^[0-9]{10,11}$") & digits.rlike("[1-9]")


def usable_email(c: Column) -> Column:
    """x@y.z that is no image file and whose name starts with neither noreply nor no-reply."""
    t = F.lower(strip_space(c))
    image = rf"\.({'|'.join(IMAGES)})$"
    return t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]+$") & ~t.rlike(image) & ~t.rlike(r"^no-?reply")


def usable_type(c: Column) -> Column:
    return c.isNotNull() & ~strip_space(c).isin("", "unknown")


def survivors(df: DataFrame, group: str, key: str, collected: str, fields: dict[str, Column]) -> DataFrame:
    """(keep_id, <field>_id ...): for each non-empty group of two rows or more, its smallest id and per field the id of the
    row collected last among those whose condition holds, '' where it holds for none.

    A missing or unreadable time counts as earliest; on a tie the smaller id is taken. A null condition is false; rows
    with a null id are left out; a repeated row counts as two, so its group has a result. One
    aggregate with map-side combining: a group that holds a third of the rows is one row per task.
    """
    late = F.coalesce(instant(F.col(collected)), F.lit(-(2**62)).cast("bigint"))
    rows = df.where(F.col(group).isNotNull() & (F.col(group) != "") & F.col(key).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).cast("string").alias("id"), (-late).alias("age"), *(F.coalesce(ok, F.lit(False)).alias(f"ok_{name}") for name, ok in fields.items())
    )
    best = [F.min(F.when(F.col(f"ok_{n}"), F.struct("age", "id"))).alias(f"best_{n}") for n in fields]
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"), *best).where("n > 1")
    return groups.select("keep_id", *(F.coalesce(F.col(f"best_{n}.id"), F.lit("")).alias(f"{n}_id") for n in fields))


_TOKEN = re.compile(r"[ァ-ヶー]+|[一-鿿々]|[ぁ-ゖ]+|[A-Za-z]+|\d+|\s+|.", re.S)


def tokens_of(value: str) -> list[str]:
    """Runs of one script, single kanji, single other characters: what votes are cast for."""
    return _TOKEN.findall(value)


class Profile:
    """A progressive alignment: columns of weighted tokens, '' for a gap."""

    def __init__(self, columns: list[dict[str, float]] | None = None, weight: float = 0.0):
        self.columns, self.weight = columns or [], weight

    @classmethod
    def of(cls, tokens: list[str], weight: float) -> Profile:
        return cls([{t: weight} for t in tokens], weight)

    def add(self, other: Profile) -> None:
        """Aligns another profile's columns to these by the votes they share, and adds its votes."""
        a, b = self.columns, other.columns
        n, m = len(a), len(b)
        if all(len(y) == 1 for y in b):  # a single value's
            single = [next(iter(y.items())) for y in b]
            shared = [[x[t] * w if t in x else 0.0 for t, w in single] for x in a]
        else:
            shared = [[sum(w * x[t] for t, w in y.items() if t and t in x) for y in b] for x in a]
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below, votes = best[i], best[i + 1], shared[i]
            for j in range(m - 1, -1, -1):
                row[j] = max(below[j], row[j + 1], below[j + 1] + votes[j])
        out, i, j = [], 0, 0
        while i < n or j < m:
            if i < n and j < m and (v := shared[i][j]) and best[i][j] == best[i + 1][j + 1] + v:
                out.append({t: a[i].get(t, 0.0) + b[j].get(t, 0.0) for t in {**a[i], **b[j]}})
                i, j = i + 1, j + 1
            elif i < n and (j == m or best[i][j] == best[i + 1][j]):
                out.append({**a[i], "": a[i].get("", 0.0) + other.weight})
                i += 1
            else:
                out.append({**b[j], "": b[j].get("", 0.0) + self.weight} if self.weight else b[j])
                j += 1
        self.columns = out
        self.weight += other.weight

    def consensus(self) -> str:
        """The token with most weight of each column; a gap wins a tie, then the smaller token."""
        return "".join(max(c, key=lambda t: (c[t], not t, t)) for c in self.columns)


def _profiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, first, w, profile) of each group's part; rows come sorted, and only the profile is held."""
    now, first, profile = None, "", None
    names = ["g", "first", "w", "profile"]
    row = lambda: (now[0], first, profile.weight, json.dumps(profile.columns))
    for f in frames:
        out = []
        for g, part, v, w in f.itertuples(index=False):
            if (g, part) != now:
                if profile:
                    out.append(row())
                now, first, profile = (g, part), v, Profile()
            profile.add(Profile.of(tokens_of(v), w))
        yield pd.DataFrame(out, columns=names)
    if profile:
        yield pd.DataFrame([row()], columns=names)


def _consensuses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, c): the consensus of each group's parts, whose profiles come sorted."""
    now, whole = None, None
    for f in frames:
        out = []
        for g, _, w, profile in f.itertuples(index=False):
            if g != now:
                if whole:
                    out.append((now, whole.consensus()))
                now, whole = g, Profile()
            whole.add(Profile(json.loads(profile), w))
        yield pd.DataFrame(out, columns=["g", "c"])
    if whole:
        yield pd.DataFrame([(now, whole.consensus())], columns=["g", "c"])


def recency(c: Column) -> Column:
    """The weight of a row by when it was collected: doubled with every year since 2020; the least where that isn't known."""
    years = F.coalesce((instant(c) / 1_000_000 - 1577836800) / (365 * 86400), F.lit(-10.0))
    return F.pow(F.lit(2.0), F.greatest(F.least(years, F.lit(20.0)), F.lit(-10.0)))


def consensus(df: DataFrame, group: str, key: str, value: str, weight: Column | None = None, parts: int = 64) -> DataFrame:
    """(keep_id, value_id, value): per non-empty group of two rows or more the existing value closest to the group's token consensus.

    Equal values are one with their weights added (1 a row by default) before anything is aligned. The values of every
    group, small or large, are dealt to `parts` by hash; each part is aligned to a profile of weighted tokens, the parts'
    profiles are aligned with all their votes, heavier ones first. So no task reads a whole hot group, and a group's size
    doesn't change how it is treated; the group's values are compared with the consensus in parallel. Ties go to the
    heavier value, then to the smaller id. Null and empty values have no vote; a group that has no other has no row; null
    ids are left out.
    """
    w = F.lit(1.0) if weight is None else F.greatest(weight.cast("double"), F.lit(0.0))
    rows = df.where(F.col(group).isNotNull() & (F.col(group) != "") & F.col(key).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("id"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"), w.alias("w"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("keep_id")).where("n > 1")
    values = rows.where("v <> ''").groupBy("g", "v").agg(F.sum("w").alias("w"), F.min("id").alias("id")).join(groups.select("g"), "g", "left_semi")
    dealt = values.select("g", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int").alias("part"), "v", "w")
    partial = dealt.repartition("g", "part").sortWithinPartitions("g", "part", F.desc("w"), "v").mapInPandas(_profiles, "g string, first string, w double, profile string")
    whole = partial.repartition("g").sortWithinPartitions("g", F.desc("w"), "first").mapInPandas(_consensuses, "g string, c string")
    judged = values.join(whole, "g").withColumn("far", F.levenshtein("v", "c"))
    best = judged.groupBy("g").agg(F.min(F.struct("far", (-F.col("w")).alias("light"), "id", "v")).alias("b"))
    return best.join(groups, "g").select("keep_id", F.col("b.id").alias("value_id"), F.col("b.v").alias("value"))
