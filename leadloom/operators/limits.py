"""Stateful mechanisms as batch operators: a sliding-log limiter and runs of equal outcomes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def window_count(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """The events with how many of their key happened in the `seconds` up to each, itself among them. [WN-05]"""
    w = W.partitionBy(key).orderBy(_micros(at)).rangeBetween(-seconds * 1_000_000, W.currentRow)
    return events.withColumn("in_window", F.count("*").over(w))


def limited(events: DataFrame, key: str, at: str, order: str, most: int, seconds: int) -> DataFrame:
    """(order, accepted): which events a limiter lets pass that counts only those it let pass. [ST-04]

    A recurrence, so each key is read in order; its state is at most `most` times. Rows are streamed in sorted partitions,
    a key is never held in memory. Null keys are one key; equal times go by `order`.
    """
    kind = events.schema[order].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, passed = object(), deque()
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"]):
                k = None if pd.isna(k) else k
                if k != now:
                    now, passed = k, deque()
                while passed and passed[0] <= t - seconds * 1_000_000:
                    passed.popleft()
                ok = len(passed) < most
                if ok:
                    passed.append(t)
                out.append(ok)
            yield pd.DataFrame({order: f["o"], "accepted": out})

    rows = events.select(F.col(key).cast("string").alias("k"), _micros(at).alias("t"), F.col(order).alias("o")).where("t IS NOT NULL")
    return rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInPandas(run, f"`{order}` {kind}, accepted boolean")


def longest_runs(events: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """(key, longest): the longest run of events in a row for which the condition holds, per key. [WN-06]"""
    w = W.partitionBy(key).orderBy(order)
    rows = events.select(key, order, hit.alias("hit")).withColumn("island", F.sum((~F.col("hit")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sizes = rows.groupBy(key, "island").agg(F.count_if("hit").alias("n"))
    return sizes.groupBy(key).agg(F.max("n").alias("longest"))


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, events): events of a key no further apart than the gap (an extension)."""
    w = W.partitionBy(key).orderBy(at)
    new = (_micros(at) - F.lag(_micros(at)).over(w)) > gap_seconds * 1_000_000
    rows = events.withColumn("session", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)).cast("bigint"))
    return rows.groupBy(key, "session").agg(F.min(at).alias("start"), F.count("*").alias("events"))


def tumbling(events: DataFrame, at: str, width: str, kind: str) -> DataFrame:
    """(start, kind, n): events per window and kind (an extension)."""
    return events.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
