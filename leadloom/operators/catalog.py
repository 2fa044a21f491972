"""The list of companies: filters, sort, pages, counts, facets, group counts, updates and deletes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.lists import LOCALISED
from leadloom.functions.text import missing, or_else

SORTS = {"collectedAt": "collected_at", "name": "name", "industry": "industry", "area": "area", "status": "status", "formType": "form_type"}
SEARCHED = ["name", "hp_url", "form_url", "phone", "email", "address", "notes"]


@dataclass(frozen=True)
class Filter:
    """What rows to take; an empty part doesn't filter. [FL-01..05]"""

    project_id: str = ""
    run_id: str = ""
    industry: str = ""
    area: str = ""
    status: str = ""
    form_type: str = ""
    run_ids: Sequence[str] = field(default_factory=tuple)
    ids: Sequence[str] = field(default_factory=tuple)
    has_form: bool | None = None
    has_phone: bool | None = None
    has_email: bool | None = None
    search: str = ""

    def condition(self) -> Column:
        out = F.lit(True)
        for c in ("project_id", "run_id", "industry", "area", "status", "form_type"):
            if getattr(self, c):
                out &= F.col(c) == getattr(self, c)
        for c, values in (("run_id", self.run_ids), ("id", self.ids)):
            if values:
                out &= F.col(c).isin(list(values))
        if self.has_form is not None:
            out &= ~missing(F.col("form_url")) if self.has_form else missing(F.col("form_url"))
        for c, wanted in (("phone", self.has_phone), ("email", self.has_email)):
            if wanted:
                out &= ~missing(F.col(c))
        if self.search:
            term = self.search.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            hit = F.lit(False)
            for c in SEARCHED:
                hit |= F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
            out &= hit
        return out


def rows(df: DataFrame, f: Filter) -> DataFrame:
    return df.where(f.condition())


def page(df: DataFrame, f: Filter, sort_by: str = "collectedAt", descending: bool = True, number: int = 1, size: int = 100) -> DataFrame:
    """One page of the filtered rows; unknown sort names mean the time of collection, ties go by id, sizes are 1 to 500. [SC-01, SL-01, SL-02]"""
    size, number = min(max(size, 1), 500), max(number, 1)
    c = F.col(SORTS.get(sort_by, "collected_at"))
    return rows(df, f).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id").offset((number - 1) * size).limit(size)


def counts(df: DataFrame, f: Filter) -> DataFrame:
    """(total, forms, phones, emails) of the filtered rows in one pass; rows asked for without something have 0 with it. [AG-01, AG-02]

    Without a phone or an e-mail is no filter: only its own count is 0.
    """

    def has(c: str, wanted: bool | None) -> Column:
        return F.count_if(~missing(F.col(c))) if wanted is not False else F.lit(0).cast("bigint")

    return rows(df, f).agg(F.count("*").alias("total"), has("form_url", f.has_form).alias("forms"), has("phone", f.has_phone).alias("phones"), has("email", f.has_email).alias("emails"))


def facet(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of a column. [AG-03, SO-03]"""
    return df.select(F.col(column).alias("value")).where(~missing(F.col("value"))).distinct()


def group_counts(df: DataFrame, column: str, missing_as: str) -> DataFrame:
    """(value, n): rows per value, empty ones under a name of their own. [AG-04]"""
    return df.groupBy(or_else(F.col(column), missing_as).alias("value")).agg(F.count("*").alias("n"))


def project_stats(projects: DataFrame, runs: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, companies, forms, runs): all projects with their numbers, 0 where they have nothing; child runs don't count. [AG-05, JN-06, FL-06]"""
    c = companies.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("companies"), F.count_if(~missing(F.col("form_url"))).alias("forms"))
    r = runs.where(F.col("parent_run_id").isNull()).groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("runs"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    return projects.select("id").join(c, "id", "left").join(r, "id", "left").select("id", zero("companies"), zero("forms"), zero("runs"))


def key_set(df: DataFrame, column: str, distinct: bool = True) -> DataFrame:
    """The non-empty values of a key column, each once or as often as it occurs. [SC-05, SC-06]"""
    out = df.select(column).where(~missing(F.col(column)))
    return out.distinct() if distinct else out


def localised(df: DataFrame, with_id: bool = False) -> DataFrame:
    """The 14 columns of the sheet view, null as ''. [PR-02]"""
    return df.select(*(["id"] if with_id else []), *(F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in LOCALISED.items()))


def from_localised(df: DataFrame) -> DataFrame:
    """Rows of the sheet view as input rows: a default status, marked as imported; rows without a form are left out. [PR-03, FL-13, SC-08]"""
    named = df.select(*(F.coalesce(F.col(name), F.lit("")).alias(c) for name, c in LOCALISED.items()))
    return named.where("form_url <> ''").withColumn("status", or_else(F.col("status"), "未送信")).withColumn("imported_from_sheets", F.lit(True))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Empty and missing values as their defaults. [PR-03..06]"""
    return df.withColumns({c: or_else(F.col(c), v) for c, v in defaults.items()})


def updated(df: DataFrame, condition: Column, values: dict[str, str]) -> DataFrame:
    """The table with some values set where the condition holds; nothing changes if none is given. [DM-03, DM-04]"""
    return df.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}) if values else df


def affected(df: DataFrame, condition: Column) -> DataFrame:
    """(affected): how many rows an update or a delete with that condition touches. [DM-04]"""
    return df.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("affected"))


def without_runs(df: DataFrame, runs: DataFrame, ids: Sequence[str], busy: Sequence[str] = ("running", "pending")) -> tuple[DataFrame, DataFrame]:
    """The table without the rows of some runs, and (run_id, affected) of the runs that went; a run that is still busy, or isn't known, keeps its rows. [DM-05]"""
    gone = runs.where(F.col("id").isin(list(ids)) & ~F.coalesce(F.col("status").isin(list(busy)), F.lit(False))).select(F.col("id").alias("run_id"))
    counts_ = df.join(gone, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("affected"))
    return df.join(gone, "run_id", "left_anti"), gone.join(counts_, "run_id", "left").select("run_id", F.coalesce("affected", F.lit(0)).cast("bigint").alias("affected"))


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows for which the condition holds. [DM-05, DM-06]"""
    return df.where(~F.coalesce(condition, F.lit(False)))


def maintained(df: DataFrame, jobs: DataFrame, busy: Sequence[str], condition: Column) -> DataFrame:
    """The table without the rows of the condition if no job is busy, else as it is. [ST-11]"""
    gone = F.coalesce(condition, F.lit(False))
    waiting = jobs.where(F.col("status").isin(list(busy))).limit(1).select(F.lit(1).alias("_one"))
    held = df.where(gone).withColumn("_one", F.lit(1)).join(F.broadcast(waiting), "_one", "left_semi").drop("_one")  # one row at most
    return df.where(~gone).unionByName(held)


def instant(c: Column) -> Column:
    """Text as a time: with its zone, else as Tokyo time, in either date form; null where it is none. [MD-07, FL-08]"""
    t = F.regexp_replace(F.trim(c), "/", "-")
    t = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t)
    return F.when(t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & t.rlike(":"), t).otherwise(F.concat(t, F.lit("+09:00"))).try_cast("timestamp")


def expired(df: DataFrame, cutoff: str, statuses: Sequence[str]) -> Column:
    """Condition: collected before the cut-off, with one of the statuses. [FL-08, DM-06]"""
    return (instant(F.col("collected_at")) < F.lit(cutoff).cast("timestamp")) & F.col("status").isin(list(statuses))
