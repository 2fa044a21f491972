"""Small reads and reports: lookups, newest and oldest, batch metrics, rates, coverage, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.functions.text import missing, or_else
from leadloom.operators.ranks import rank_in_group


def newest(df: DataFrame, at: str = "created_at", most: int | None = None) -> DataFrame:
    """Rows, newest first, ties by id; the first `most` of them. [SC-02, SC-21, SL-03]"""
    out = df.orderBy(F.col(at).desc_nulls_last(), "id")
    return out if most is None else out.limit(most)


def oldest(df: DataFrame, condition: Column, at: str = "created_at", most: int = 1) -> DataFrame:
    """The first rows for which a condition holds, ties by id: the next in a line. [SL-04, FL-24]"""
    return df.where(condition).orderBy(F.col(at).asc_nulls_last(), "id").limit(most)


def lookup(df: DataFrame, column: str, value: str, at: str | None = None) -> DataFrame:
    """The row with a value, at most one: the newest if `at` names a time. [SC-03]"""
    hit = df.where(F.col(column) == value)
    return (hit.orderBy(F.col(at).desc_nulls_last(), "id") if at else hit.orderBy("id")).limit(1)


def of_parent(df: DataFrame, column: str, value: str, at: str = "created_at") -> DataFrame:
    """The rows that belong to something, newest first. [SC-04, SC-09]"""
    return newest(df.where(F.col(column) == value), at)


def idle(jobs: DataFrame, busy: Sequence[str]) -> DataFrame:
    """(idle): whether no job has one of the statuses. [FL-11]"""
    return jobs.agg((F.count_if(F.col("status").isin(list(busy))) == 0).alias("idle"))


def host_set(df: DataFrame, column: str) -> DataFrame:
    """(host): the hosts of a column of addresses, each once. [SC-10]"""
    return df.select(urls.host_key(F.col(column)).alias("host")).where("host <> ''").distinct()


def until_short_page(pages: DataFrame, key: str, number: str, size: str, full: int) -> DataFrame:
    """The pages of each search up to the first that isn't full. [SC-13, SC-14, SC-15]"""
    before = W.partitionBy(key).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("_short", F.coalesce(F.max((F.col(size) < full).cast("int")).over(before), F.lit(0))).where("_short = 0").drop("_short")


def until_enough(df: DataFrame, group: str, order: str, amount: str, most: int) -> DataFrame:
    """The rows of each group, in order, taken while what came before is less than `most`. [SL-07]"""
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_sum", F.coalesce(F.sum(amount).over(before), F.lit(0))).where(F.col("_sum") < most).drop("_sum")


def known_areas(df: DataFrame, area: str, areas: DataFrame, failed: Column | None = None) -> DataFrame:
    """The rows with whether their area is known; an empty area passes, and one whose lookup `failed`. [SC-19]"""
    names = areas.select(F.col(areas.columns[0]).alias(area)).distinct().withColumn("_known", F.lit(True))
    return df.join(names, area, "left").withColumn("valid", F.coalesce("_known", missing(F.col(area)) | F.coalesce(F.lit(False) if failed is None else failed, F.lit(False)))).drop("_known")


def camel(df: DataFrame) -> DataFrame:
    """The table with its columns in camel case. [PR-01]"""
    name = lambda c: c.split("_")[0] + "".join(p.title() for p in c.split("_")[1:])
    return df.select(*(F.col(c).alias(name(c)) for c in df.columns))


def payloads(df: DataFrame, group: str, order: str, fields: Sequence[str], size: int = 1000) -> DataFrame:
    """(group, part, n, items): each group's rows in order as arrays of at most `size`, numbered from 0. [PR-07]

    A group is cut at every `size` rows of its order, so none has to fit into one array or to be read by one task.
    """
    numbered = rank_in_group(df.select(group, order, *fields), group, [order, *fields], "_rank").withColumn("part", F.floor((F.col("_rank") - 1) / size))
    rows = numbered.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))
    return rows.select(group, "part", F.size("items").cast("bigint").alias("n"), "items")


def split_by(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """The rows with the name of the first gate whose condition holds, 'else' if none does. [FL-15]"""
    out = F.lit("else")
    for name, condition in reversed(gates.items()):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return df.withColumn("gate", out)


def filtered_history(history: DataFrame, status: str = "", term: str = "") -> DataFrame:
    """Runs of a status whose label or project holds a term in any case. [FL-14]"""
    out = history.where(F.col("status") == status) if status else history
    low = term.lower()
    return out.where(F.contains(F.lower("label"), F.lit(low)) | F.contains(F.lower("project_name"), F.lit(low))) if low else out


def recovered(jobs: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """(id, status): active jobs whose run has ended take its outcome, others stay; a finished run never turns to an error. [JN-10, JN-16]"""
    ends = runs.select(F.col("id").alias(run_id), F.col("status").alias("run_status"))
    done = F.when(F.col("run_status").isin("success", "completed"), "completed").when(F.col("run_status") == "error", "failed")
    return jobs.join(ends, run_id, "left").select("id", F.when(F.col("status") == "active", F.coalesce(done, F.col("status"))).otherwise(F.col("status")).alias("status"))


def batch_metrics(df: DataFrame, error: Column, found: Column, hint: Column, millis: Column | None = None) -> DataFrame:
    """(total, success, errors, found, rate, inquiry, booking, line, avg_ms) of a batch of pages. [AG-08, AG-09, MD-05]"""
    n, ok = F.count("*"), F.count_if(~F.coalesce(error, F.lit(False)))
    hits = F.count_if(F.coalesce(found, F.lit(False)))
    kind = lambda k: F.count_if(F.coalesce(hint, F.lit("")) == k)
    ms = F.coalesce(F.round(F.avg(millis)), F.lit(0)).cast("bigint") if millis is not None else F.lit(0).cast("bigint")
    return df.agg(n.alias("total"), ok.alias("success"), (n - ok).alias("errors"), hits.alias("found"), percent(hits, n).alias("rate"), kind("inquiry").alias("inquiry"), kind("booking").alias("booking"), kind("LINE").alias("line"), ms.alias("avg_ms"))


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, 0 of nothing. [MD-05]"""
    return F.when(whole > 0, F.round(100 * part / whole)).otherwise(0).cast("bigint")


def outcomes(df: DataFrame, outcome: Column) -> DataFrame:
    """(outcome, n): how many rows came to which end. [AG-16]"""
    return df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def targets(requests: DataFrame, words: str, areas: str) -> DataFrame:
    """(targets): keyword by area pairs of all requests; no areas count as one. [AG-17, JN-14]"""
    return requests.agg(F.sum(F.coalesce(F.size(words), F.lit(0)) * F.greatest(F.coalesce(F.size(areas), F.lit(0)), F.lit(1))).cast("bigint").alias("targets"))


def per_minute(df: DataFrame, amount: str, start: Column, end: Column) -> DataFrame:
    """The rows with their amount per whole minute, null where no time has passed. [AG-18]"""
    ms = F.unix_millis(end) - F.unix_millis(start)
    return df.withColumn("per_minute", F.when(ms > 0, F.floor(F.col(amount) * 60000 / ms)))


def by_host(df: DataFrame, url: str, most: int) -> DataFrame:
    """(host, n, percent): the commonest hosts. [AG-20, SL-03]"""
    hosts = df.select(urls.host_key(F.col(url)).alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    total = hosts.agg(F.sum("n").alias("t")).withColumn("_one", F.lit(1))
    top = hosts.orderBy(F.desc("n"), "host").limit(most).withColumn("_one", F.lit(1))
    return top.join(total, "_one").select("host", "n", percent(F.col("n"), F.col("t")).alias("percent"))


def shares(df: DataFrame, group: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row per group with the number of rows of each value. [AG-20]"""
    return df.groupBy(group).agg(*(F.count_if(F.coalesce(F.col(column), F.lit("")) == v).alias(f"n_{v.lower() or 'none'}") for v in values), F.count("*").alias("n"))


def coverage(df: DataFrame, group: str, estimates: DataFrame) -> DataFrame:
    """(group, stored, estimate, percent): how much of what is estimated is stored. estimates: (group, estimate). [AG-21]"""
    have = df.groupBy(group).agg(F.count("*").alias("stored"))
    out = estimates.join(have, group, "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return out.select(group, "stored", "estimate", F.when(F.col("estimate") > 0, F.round(100 * F.col("stored") / F.col("estimate"), 1)).otherwise(0.0).alias("percent"))


def suggestions(df: DataFrame, column: str, term: str, most: int = 8) -> DataFrame:
    """The first distinct values that hold a term. [SL-09]"""
    return df.select(F.col(column).alias("value")).where(F.contains(F.lower("value"), F.lit(term.lower()))).distinct().orderBy("value").limit(most)


def appended_id(ids: Column, new: Column) -> Column:
    """A list of ids with one more, each once, the others in order. [SO-04]"""
    return F.array_union(F.coalesce(ids, F.array().cast("array<string>")), F.array(new))


def removed_id(ids: Column, gone: Column) -> Column:
    """A list of ids without one. [SO-04]"""
    return F.array_remove(F.coalesce(ids, F.array().cast("array<string>")), gone)


def all_ids(df: DataFrame, lists: str) -> DataFrame:
    """(id): the members of all lists. [SO-02, SO-05]"""
    return df.select(F.explode(lists).alias("id"))


def capped(c: Column, most: int) -> Column:
    """A text cut to so many code points; null stays null. [TX-14]"""
    return F.substring(c, 1, most)


def point_text(lat: Column, lng: Column) -> Column:
    """A point with four decimals each. [MD-12]"""
    return F.concat_ws(", ", F.format_string("%.4f", lat), F.format_string("%.4f", lng))


def with_ids(df: DataFrame, prefix: str) -> DataFrame:
    """Rows with random ids; never for results that are compared. [MD-10]"""
    return df.withColumn("id", F.concat(F.lit(prefix), F.expr("uuid()")))


def append(df: DataFrame, path: str, batch: str) -> None:
    """Rows added to a table under the name of their batch; a batch written twice is there once. [SK-01, SK-06]"""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_type(c: Column) -> Column:
    """A form type for reports, empty as unknown. [AG-20]"""
    return or_else(c, "unknown")
