"""Ranks over a whole table or a large group, without one task reading it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.sources.tables import cut


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """The rows with their place in the whole table by `order`, from 1; nulls come first, equal rows in any order.

    The table is cut into ranges, each is ranked by itself, and the rows of the ranges before are added: one row a range.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.withColumn(name, inside).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_range", "_before")


def rank_in_group(df: DataFrame, group: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """The rows with their place among those of their group by `order`, from 1; null is a group.

    Ranks over all rows by group and order, less the least of the group: a group that holds a third of the rows is spread.
    """
    ranked = global_rank(df, [group, *order], name)
    firsts = ranked.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    return ranked.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_group", "_first")
