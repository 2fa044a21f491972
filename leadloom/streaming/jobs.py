"""Structured Streaming counterparts: ingestion, windowed counts, deduplicating ingestion, the limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from leadloom.operators.dedup import first_wins, without_known


def incoming(spark: SparkSession, path: str, schema: StructType, form: str = "json") -> DataFrame:
    """Files that arrive in a folder, as a stream. [SC-22]"""
    return spark.readStream.schema(schema).format(form).load(path)


def counts(events: DataFrame, at: str, width: str, late: str, kind: str) -> DataFrame:
    """(start, kind, n): counts per window, final once the watermark has passed (an extension)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def append_new(table: str, key: str, order: str):
    """A foreachBatch function: appends the rows whose key the Parquet table lacks, each key once. Run twice, it adds nothing. [ST-09]"""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(table)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        new = first_wins(batch, [key], [order])
        (without_known(new, spark.read.parquet(table), key) if there else new).write.mode("append").parquet(table)

    return run


def limited(events: DataFrame, key: str, at: str, most: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """(key, at, accepted): the sliding-log limiter with its log as state, at most `most` times a key. [ST-04]

    A key's state goes once the watermark has passed its last time by the window.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for t in rows[at]:
            now = t.value // 1000
            log = [x for x in log if x > now - seconds * 1_000_000]
            out.append(len(log) < most)
            if out[-1]:
                log.append(now)
        state.update((log,))
        state.setTimeoutTimestamp(max(max(log, default=0) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), at: list(rows[at]), "accepted": out})

    types = dict(events.dtypes)
    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {at} timestamp, accepted boolean", "log array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
