"""Differences between two copies of a dataset."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import filled


@dataclass(frozen=True)
class Compared:
    """A value both copies hold: its label in the result and its expression on either side."""

    label: str
    left: Column
    right: Column


def _merge(labels: Sequence[str], left_only: str, right_only: str):
    """Streams rows sorted by key and side; a key's rows on both sides are neighbours, so two pointers one row apart meet them."""

    def rows_of(keys: pa.Array, mask: np.ndarray, label: str) -> pa.RecordBatch:
        ids = keys.filter(pa.array(mask))
        return pa.record_batch([ids, pa.array([label] * len(ids), pa.string())], names=["id", "difference"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def compare(t: pa.RecordBatch, last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
            n = t.num_rows
            key, side = t.column(0), np.asarray(t.column(1))
            first = np.zeros(n, bool)
            if n > 1:
                first[:-1] = np.asarray(pc.equal(key.slice(0, n - 1), key.slice(1)))
            second = np.zeros(n, bool)
            second[1:] = first[:-1]
            alone = ~(first | second)
            keep = None
            if not last and alone[-1]:
                alone[-1] = False
                keep = t.slice(n - 1)
            out = [rows_of(key, alone & (side == 0), left_only), rows_of(key, alone & (side == 1), right_only)]
            at = np.flatnonzero(first)
            if len(at):
                here, there = pa.array(at), pa.array(at + 1)
                for i, label in enumerate(labels):
                    c = t.column(2 + i)
                    unequal = np.asarray(pc.not_equal(c.take(here), c.take(there)))
                    mask = np.zeros(n, bool)
                    mask[at[unequal]] = True
                    out.append(rows_of(key, mask, label))
            return [b for b in out if b.num_rows], keep

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            found, held = compare(b, last=False)
            yield from found
        if held is not None:
            yield from compare(held, last=True)[0]

    return run


def differences(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    values: Iterable[Compared],
    left_only: str,
    right_only: str,
    left_order: Column | None = None,
    right_order: Column | None = None,
) -> DataFrame:
    """(id, difference): keys only one side has, and for shared keys each value that is unequal.

    Both copies go through one range exchange, which samples them together, so they share their split points; they are
    sorted within the partitions, and a streaming merge compares neighbours. Before the exchange each key is brought to
    one row per side with map-side combining, so a key that holds much of a copy costs no more than any other.

    Null keys belong to no row and are left out. If a side repeats a key, the row with the largest order counts; on a tie
    (or without an order) the one with the larger values. Values are compared without surrounding white space, null as
    ''. An empty side makes all keys of the other side come out; two empty sides give no row. Other columns are ignored.
    """
    values = list(values)
    zero = F.lit(0).cast("bigint")

    def one(df: DataFrame, key: Column, side: int, order: Column | None) -> DataFrame:
        fields = [filled(v.right if side else v.left).alias(f"v{i}") for i, v in enumerate(values)]
        return df.select(key.cast("string").alias("k"), F.lit(side).cast("int").alias("side"), F.struct((zero if order is None else F.coalesce(order.cast("bigint"), zero)).alias("o"), *fields).alias("v")).where(F.col("k").isNotNull())

    both = one(left, left_key, 0, left_order).unionAll(one(right, right_key, 1, right_order))
    rows = both.groupBy("k", "side").agg(F.max("v").alias("v")).select("k", "side", *(F.col(f"v.v{i}") for i in range(len(values))))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "side")
    return ordered.mapInArrow(_merge([v.label for v in values], left_only, right_only), "id string, difference string")
