"""Pairs of the rows that share a key."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a sketch that says how common a token is; its size doesn't depend on the data.
COUNTERS = 1 << 16


@functools.lru_cache(200_000)
def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def sketch(tokens: DataFrame, column: str = "token") -> np.ndarray:
    """How often each counter's tokens occur: COUNTERS numbers, added up before the shuffle and fetched by one job, not by one a partition."""
    counts = np.zeros(COUNTERS, np.int64)
    found = tokens.groupBy(F.pmod(F.col(column), F.lit(COUNTERS)).cast("int").alias("c")).count().toArrow()
    counts[found["c"].to_numpy()] = found["count"].to_numpy()
    return counts


class Rarity:
    """What a token weighs: the logarithm of how few of all rows have it."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total = counts, total

    def weight(self, token: int) -> float:
        return float(np.log1p(self.total / max(1, int(self.counts[token % COUNTERS]))))

    @property
    def most(self) -> float:
        """The weight of a token that one row has."""
        return float(np.log1p(self.total))


def hash128(c: Column) -> list[Column]:
    """Two 64-bit hashes of `c` with different seeds."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("leadloom"), c, F.length(c)).alias("h2")]


def self_pairs(rows: DataFrame, keys: Sequence[str], item: str = "id") -> DataFrame:
    """(id_a, id_b) with id_a < id_b of rows that agree in all `keys`; each pair once.

    Rows that appear twice pair only once, and not with themselves.
    """
    a = rows.select(*keys, F.col(item).alias("id_a"))
    b = rows.select(*keys, F.col(item).alias("id_b"))
    return a.join(b, list(keys)).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
