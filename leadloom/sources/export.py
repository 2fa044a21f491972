"""Exports: CSV lines, file names, sheet tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.lists import LOCALISED
from leadloom.operators.catalog import localised
from leadloom.operators.runs import tree_ids

BOM = "﻿"


def csv_line(*columns: Column) -> Column:
    """A line with every value quoted and quotes doubled, null as "". [SK-02]"""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))


def csv_lines(companies: DataFrame) -> DataFrame:
    """(id, line) of the sheet view. [SK-02, PR-02]"""
    view = localised(companies, with_id=True)
    return view.select("id", csv_line(*(F.col(f"`{c}`") for c in LOCALISED)).alias("line"))


def csv_header() -> str:
    return BOM + ",".join(LOCALISED)


def write_csv(companies: DataFrame, path: str, order: list[str]) -> None:
    """The sheet view as CSV parts in a folder, in order; the first one begins with byte-order mark and header. [SK-02]

    Parts are range-partitioned, so their names give the order: joined, they are one file.
    """
    lines = csv_lines(companies.repartitionByRange(*order).sortWithinPartitions(*order)).select("line")
    header = csv_header()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:
            yield pa.record_batch([pa.array([header])], names=["value"])
        for b in batches:
            yield pa.record_batch([b.column(0)], names=["value"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def file_name(label: Column, default: str, day: str) -> Column:
    """The export's name: the label with spaces, slashes and colons as underscores, and the day. [SK-03, TX-13]"""
    return F.concat(F.coalesce(F.regexp_replace(label, r"[\s/:]", "_"), F.lit(default)), F.lit(f"_{day}.csv"))


def tab_title(label: Column) -> Column:
    """A tab's title: no special characters, 100 characters at most. [SK-05, TX-13]"""
    return F.substring(F.regexp_replace(label, r"[\\/?*\[\]:]", "_"), 1, 100)


def tabs(companies: DataFrame, runs: DataFrame) -> DataFrame:
    """(tab, id): one tab with all rows and one per top-level run with its own and its children's. [SK-04, JN-09]"""
    members = tree_ids(runs).join(runs.select(F.col("id").alias("run_id"), tab_title(F.col("label")).alias("tab")), "run_id")
    per_run = companies.select("id", F.col("run_id").alias("member_id")).join(members, "member_id").select("tab", "id")
    return companies.select(F.lit("全件").alias("tab"), "id").unionAll(per_run)


def write_tabs(companies: DataFrame, runs: DataFrame, path: str) -> None:
    """The tabs as folders of Parquet files. [SK-04]"""
    rows = tabs(companies, runs).join(localised(companies, with_id=True), "id")
    rows.write.mode("overwrite").partitionBy("tab").parquet(path)
