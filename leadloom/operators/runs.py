"""Runs and their trees: histories, roll-ups, ranks, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.operators.ranks import global_rank

GOOD = ["success", "completed"]


def children(runs: DataFrame) -> DataFrame:
    """(parent_id, child_id): listed in the parent, or naming it, each once. [JN-08]"""
    listed = runs.select(F.col("id").alias("parent_id"), F.explode("child_run_ids").alias("child_id"))
    naming = runs.where(F.col("parent_run_id").isNotNull()).select(F.col("parent_run_id").alias("parent_id"), F.col("id").alias("child_id"))
    return listed.unionAll(naming).distinct()


def tree_ids(runs: DataFrame) -> DataFrame:
    """(run_id, member_id): each top-level run with itself and its children. [JN-09]"""
    top = runs.where(F.col("parent_run_id").isNull()).select(F.col("id").alias("run_id"))
    kids = children(runs).select(F.col("parent_id").alias("run_id"), F.col("child_id").alias("member_id"))
    return top.select("run_id", F.col("run_id").alias("member_id")).unionAll(kids.join(top, "run_id", "left_semi")).distinct()


def rolled_up(runs: DataFrame) -> DataFrame:
    """(id, status, items_written, tokens_input, tokens_output, raw_search_count, n_children) of batch runs whose children have all ended. [AG-06]

    Missing numbers add nothing; sums of 0 are null but for items. One good child makes the batch good.
    """
    pairs = runs.select(F.col("id").alias("parent_id"), F.explode("child_run_ids").alias("child_id"))
    kids = runs.select(F.col("id").alias("child_id"), "status", "items_written", "tokens_input", "tokens_output", "raw_search_count")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    sums = pairs.join(kids, "child_id").groupBy("parent_id").agg(
        F.bool_and(F.col("status").isin(*GOOD, "error")).alias("ended"), F.bool_or(F.col("status").isin(GOOD)).alias("good"), total("items_written").cast("bigint").alias("items_written"),
        *(F.nullif(total(c), F.lit(0)).cast("bigint").alias(c) for c in ("tokens_input", "tokens_output", "raw_search_count")), F.count("*").alias("n_children"),
    )
    return sums.where("ended").select(F.col("parent_id").alias("id"), F.when(F.col("good"), "success").otherwise("error").alias("status"), "items_written", "tokens_input", "tokens_output", "raw_search_count", "n_children")


def roll_up_needed(runs: DataFrame) -> DataFrame:
    """The roll-ups that would change their run. [AG-07]"""
    now = runs.select("id", F.col("status").alias("s"), F.col("items_written").alias("i"), F.col("completed_at").alias("c"))
    same = F.col("s").isin(GOOD) & F.col("i").eqNullSafe(F.col("items_written")) & F.col("c").isNotNull()
    return rolled_up(runs).join(now, "id").where(~F.coalesce(same, F.lit(False))).drop("s", "i", "c")


def duration_text(start: Column, end: Column) -> Column:
    """How long a run took, in hours and minutes or minutes and seconds; '-' if it hasn't ended or ends before it starts. [MD-08]"""
    s = F.floor((F.unix_millis(end) - F.unix_millis(start)) / 1000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit("時間"), (m % 60).cast("string"), F.lit("分"))).otherwise(F.concat(m.cast("string"), F.lit("分"), (s % 60).cast("string"), F.lit("秒")))
    return F.when(s >= 0, text).otherwise(F.lit("-"))


def history(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Top-level runs, newest first, with their project's name (its id where it is gone) and how long they took. [JN-07, SL-05, FL-06]"""
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    top = runs.where(F.col("parent_run_id").isNull()).join(names, "project_id", "left")
    start, end = F.col("created_at").try_cast("timestamp"), F.col("completed_at").try_cast("timestamp")
    return top.select("id", F.coalesce("project_name", "project_id").alias("project_name"), "label", "status", "created_at", F.coalesce(duration_text(start, end), F.lit("-")).alias("duration")).orderBy(F.desc("created_at"), "id")


def conversion(runs: DataFrame) -> DataFrame:
    """(id, written_rate, written_band, found_rate, found_band): rows kept of those searched and forms found of those left, each in three bands. [AG-19]"""
    w = F.when(F.col("raw_search_count") > 0, F.col("items_written") / F.col("raw_search_count"))
    f = F.when(F.col("results.afterDedup") > 0, 100 * F.col("results.formFoundCount") / F.col("results.afterDedup"))
    band = lambda c, high, mid: F.when(c >= high, "high").when(c >= mid, "middle").when(c.isNotNull(), "low")
    return runs.select("id", F.round(100 * w, 1).alias("written_rate"), band(w, 0.1, 0.05).alias("written_band"), F.round(f, 1).alias("found_rate"), band(f, 50, 20).alias("found_band"))


def success_share(runs: DataFrame, newest: int = 10) -> DataFrame:
    """(n, good, percent): how many of the newest runs ended well. [AG-13]"""
    last = runs.orderBy(F.desc("created_at"), "id").limit(newest)
    return last.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(GOOD)).alias("good")).withColumn("percent", F.when(F.col("n") > 0, F.round(100 * F.col("good") / F.col("n"))).otherwise(0).cast("bigint"))


def queue_position(jobs: DataFrame, waiting: str = "waiting") -> DataFrame:
    """(id, position): the place of each waiting job by time of creation, 0 for the others. [WN-02]

    The waiting jobs are ranked in ranges, so a long queue isn't read by one task.
    """
    ranked = global_rank(jobs.where(F.col("status") == waiting).select("id", "created_at"), ["created_at", "id"], "position").select("id", "position")
    return jobs.select("id").join(ranked, "id", "left").select("id", F.coalesce("position", F.lit(0)).cast("bigint").alias("position"))


def keep_newest(df: DataFrame, keep: int, group: Sequence[str], order: Column) -> DataFrame:
    """The newest `keep` rows of each group, ties by id. [WN-03, DM-07]"""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(order.desc_nulls_last(), "id"))).where(F.col("_n") <= keep).drop("_n")


def stale(runs: DataFrame, now: str, limits: dict[str, str]) -> DataFrame:
    """(id, status, stale): unfinished rows older than their status allows, as of `now`. limits: status to interval text. [FL-09, FL-10, DM-10]"""
    at = F.col("created_at").try_cast("timestamp")
    old = F.lit(False)
    for status, age in limits.items():
        old |= (F.col("status") == status) & (at < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {age}"))
    return runs.select("id", "status", F.coalesce(old, F.lit(False)).alias("stale"))


def _three(n: Column) -> Column:
    """A number with three digits at least. [TX-16]"""
    text = n.cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def next_number(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """(next_id): the prefix with the largest number in use plus one, three digits at least. [AG-15, TX-16, FL-07, SC-07]"""
    n = F.regexp_extract(F.col(column), r"(\d+)$", 1).try_cast("int")
    used = df.where(F.startswith(F.col(column), F.lit(prefix))).agg(F.coalesce(F.max(n), F.lit(0)).alias("n"))
    return used.select(F.concat(F.lit(prefix), _three(F.col("n") + 1)).alias("next_id"))


def next_by_count(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """(next_id): the prefix with how many ids begin with it plus one, three digits at least. [AG-15, TX-16]"""
    used = df.where(F.startswith(F.col(column), F.lit(prefix))).agg(F.count("*").alias("n"))
    return used.select(F.concat(F.lit(prefix), _three(F.col("n") + 1)).alias("next_id"))


def with_new(df: DataFrame, values: dict[str, object], prefix: str = "run-") -> DataFrame:
    """A configuration's runs with one more, whose id is the largest number in use plus one. [DM-09, AG-15]

    Values of other columns are null.
    """
    n = F.regexp_extract(F.col("id"), rf"^{prefix}(\d+)", 1).try_cast("int")
    new_id = F.concat(F.lit(prefix), _three(F.coalesce(F.max(n), F.lit(0)) + 1))
    kinds = dict(df.dtypes)
    row = df.agg(new_id.alias("id")).select(*(F.col("id") if c == "id" else F.lit(values.get(c)).cast(kinds[c]).alias(c) for c in df.columns))
    return df.unionByName(row)


def without(df: DataFrame, run_id: str) -> DataFrame:
    """A configuration's runs without one; nothing changes if it isn't there. [DM-09]"""
    return df.where(~F.col("id").eqNullSafe(F.lit(run_id)))


def toggled(df: DataFrame, run_id: str, column: str = "enabled") -> DataFrame:
    """A configuration's runs with one switched on or off; a null switch counts as off. [DM-09]"""
    return df.withColumn(column, F.when(F.col("id") == run_id, ~F.coalesce(F.col(column), F.lit(False))).otherwise(F.col(column)))


#: What an execution's nodes say of the tokens they used.
_NODES = "map<string,array<struct<data:struct<main:array<array<struct<json:struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>>>>>>>"


def node_tokens(executions: DataFrame, key: str, body: str) -> DataFrame:
    """(key, tokens_input, tokens_output): sums over all results of all nodes of each execution, of each result its first item. [AG-14]

    Null where nothing was used or the body can't be read.
    """
    results = F.flatten(F.map_values(F.from_json(F.col(body), _NODES)))
    usage = F.transform(results, lambda r: F.try_element_at(F.try_element_at(r["data"]["main"], F.lit(1)), F.lit(1))["json"]["usage"])
    total = lambda name: F.aggregate(usage, F.lit(0).cast("bigint"), lambda n, u: n + F.coalesce(u[name], F.lit(0)))
    sums = executions.select(key, total("prompt_tokens").alias("tokens_input"), total("completion_tokens").alias("tokens_output"))
    used = (F.col("tokens_input") > 0) | (F.col("tokens_output") > 0)
    return sums.select(key, F.when(used, F.col("tokens_input")).alias("tokens_input"), F.when(used, F.col("tokens_output")).alias("tokens_output"))


def latest_values(events: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """The last given value of each field per key; a missing value leaves the one before. [ST-07]"""
    return events.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def token_totals(runs: DataFrame) -> DataFrame:
    """(project_id, tokens_input, tokens_output, items_written): sums per project, missing as 0. [AG-14]"""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c)
    return runs.groupBy("project_id").agg(total("tokens_input"), total("tokens_output"), total("items_written"))


def actual_counts(runs: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, items): the rows a run really has, where it has any, else what it reports. [AG-12]"""
    n = companies.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    return runs.join(n, "id", "left").select("id", F.when(F.col("n") > 0, F.col("n")).otherwise(F.coalesce("items_written", F.lit(0))).cast("bigint").alias("items"))


def child_targets(runs: DataFrame) -> DataFrame:
    """(parent_id, ord, target): a batch run's target for each of its areas: the area replaced, the list of areas dropped. [PR-10, ST-08]"""
    parents = runs.where(F.size("search_target.areas") > 1).select(F.col("id").alias("parent_id"), "search_target", F.posexplode("search_target.areas").alias("ord", "one"))
    return parents.select("parent_id", F.col("ord").cast("bigint").alias("ord"), F.col("search_target").withField("area", F.col("one")).dropFields("areas").alias("target"))


def retries(runs: DataFrame) -> DataFrame:
    """(run_id, industry, area, keywords, max_results): requests made from the stored targets of failed runs; no keywords mean the industry. [PR-14, PR-09]"""
    t = F.col("search_target")
    words = F.when(F.coalesce(F.size(t["keywords"]), F.lit(0)) > 0, t["keywords"]).otherwise(F.array(t["industry"]))
    return runs.where("status = 'error'").select(F.col("id").alias("run_id"), t["industry"].alias("industry"), t["area"].alias("area"), words.alias("keywords"), t["maxResults"].alias("max_results"))
