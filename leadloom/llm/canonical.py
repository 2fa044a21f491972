"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.pairs import hash128, self_pairs
from leadloom.sources.tables import cut


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]+", "")


def canonical_url(c: Column) -> Column:
    """The letters and digits of a URL in lower case, its parameters in order; null as ''.

    White space, punctuation and case are left out, and the parameters between `?` and `#` are sorted.
    """
    c = F.coalesce(c, F.lit(""))
    base = F.regexp_extract(c, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(c, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(c, r"(?s)#(.*)$", 1)
    return F.concat(_letters(base), F.array_join(F.array_sort(F.transform(F.split(query, "&"), _letters)), ""), _letters(fragment))


def hashed(df: DataFrame, key: str, fields: Sequence[Column]) -> DataFrame:
    """(id, h1, h2, check): 128 bits of the canonical fields and a third hash of them in another order."""
    text = F.concat_ws("\x1f", *fields)
    rows = df.select(F.col(key).cast("string").alias("id"), text.alias("text"))
    return rows.select("id", *hash128(F.col("text")), F.xxhash64(F.reverse(F.col("text"))).alias("check"))


def copy_sets(rows: DataFrame) -> DataFrame:
    """(h1, h2, check, keep_id, copies): one row per set of copies, single rows included.

    Counts are combined before the exchange, so a set that holds a third of the rows costs one row per task. Rows whose
    128 bits agree but whose third hash differs are different texts that collide; the check is part of the key, so they
    stay apart.
    """
    return rows.groupBy("h1", "h2", "check").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copies(df: DataFrame, key: str, fields: Sequence[Column]) -> DataFrame:
    """(keep_id, copies): the smallest id of each set of copies and how many rows it has. Null ids count as rows."""
    return copy_sets(hashed(df, key, fields)).select("keep_id", "copies")


def copy_members(df: DataFrame, key: str, fields: Sequence[Column]) -> DataFrame:
    """(id, keep_id): each row that has copies with the smallest id of its set: what pairs say, one row a record. Null ids have no row."""
    rows = hashed(df, key, fields)
    many = copy_sets(rows).where("copies > 1").drop("copies")
    return rows.where("id IS NOT NULL").join(many, ["h1", "h2", "check"]).select("id", "keep_id").distinct()


def copy_pairs(df: DataFrame, key: str, fields: Sequence[Column]) -> DataFrame:
    """(id_a, id_b) of rows whose canonical fields agree, id_a < id_b. Empty fields agree with empty ones.

    Only sets of two rows or more meet in a join; the sets are found from counts combined before the exchange.
    """
    rows = hashed(df, key, fields)
    many = rows.groupBy("h1", "h2", "check").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = cut(rows.join(many, ["h1", "h2", "check"], "left_semi"))
    return self_pairs(kept, ["h1", "h2", "check"])
