"""First-wins deduplication as windows, and the upsert that upgrades stored rows.

Every input carries an order column: "first" always means the smallest order, ties by the other columns given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions.text import missing, or_else


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Rows whose key is null or '' have no key and all stay. [WN-01]

    A rank-one window: Spark drops later rows of a key before the exchange (window group limit), so hot keys are small.
    """
    empty = None
    for k in keys:
        empty = missing(F.col(k)) if empty is None else empty & missing(F.col(k))
    ranked = df.where(~empty).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return ranked.unionByName(df.where(empty))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as a map filled in order leaves it. [JN-05]"""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).where("_n = 1").drop("_n")


def _spread(df: DataFrame, key: str) -> Column:
    """The key, or one of many that nothing has where it is missing: rows without a key don't gather in one task."""
    return F.when(missing(F.col(key)), F.concat(F.lit("\0"), F.pmod(F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t)), F.lit(4096)).cast("string"))).otherwise(F.col(key))


def without_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key the known table lacks; rows without a key stay. [JN-01, JN-04]"""
    keys = known.select(F.col(key).alias("_key")).where(~missing(F.col("_key"))).distinct()
    return df.withColumn("_key", _spread(df, key)).join(keys, "_key", "left_anti").drop("_key")


def marked_known(df: DataFrame, known: DataFrame, key: str, mark: str) -> DataFrame:
    """The rows with a column that says whether the known table has their key. [JN-02]"""
    keys = known.select(F.col(key).alias("_key")).where(~missing(F.col("_key"))).distinct().withColumn(mark, F.lit(True))
    return df.withColumn("_key", _spread(df, key)).join(keys, "_key", "left").drop("_key").withColumn(mark, F.coalesce(mark, F.lit(False)))


def merged_sources(sources: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of several sources, those of an earlier source first, one per key. A failed source is an empty frame. [SO-01]"""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return first_wins(out, [key], ["source_rank", order])


def places(df: DataFrame, place: str, host: str, order: str) -> DataFrame:
    """One row per place, then one per host; rows without a host stay. [WN-01 of places]"""
    return first_wins(df.withColumn("_n", F.row_number().over(W.partitionBy(place).orderBy(order))).where("_n = 1").drop("_n"), [host], [order])


def batch_report(df: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """(total, unique_rows, duplicate_rows, duplicate_rate): what first-wins against a known table would keep; the rate is 0 for no rows. [JN-04, AG-10]"""
    kept = first_wins(df if known is None else without_known(df, known, key), [key], [order])
    a, b = df.agg(F.count("*").alias("total")), kept.agg(F.count("*").alias("unique_rows"))
    both = a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
    lost = F.col("total") - F.col("unique_rows")
    return both.select("total", "unique_rows", lost.alias("duplicate_rows"), F.when(F.col("total") > 0, F.round(100 * lost / F.col("total"))).otherwise(0).cast("bigint").alias("duplicate_rate"))


def computed_once(df: DataFrame, key: str, compute) -> DataFrame:
    """`compute` over the distinct keys, joined back to all rows that have them. [JN-15]"""
    return df.join(compute(df.select(key).distinct()), key, "left")


def resolved_type(form_url_is_line: Column, given: Column) -> Column:
    """The stored form type: a chat link decides, a booking is stored as reservation, else as given. [CL-19]"""
    return F.when(form_url_is_line, "LINE").when(given == "booking", "reservation").otherwise(F.coalesce(given, F.lit("")))


def with_first(df: DataFrame, key: str, turn: Sequence[str], mark: str, among: Column | None = None) -> DataFrame:
    """The rows with whether each is the first of its key, of those for which `among` holds; rows without a key aren't.

    The first row is found by an aggregate with map-side combining and marked by a join on the turn, which is unique: a key
    that many rows have costs no more than another.
    """
    rows = df.where(~missing(F.col(key))) if among is None else df.where(~missing(F.col(key)) & among)
    firsts = rows.groupBy(key).agg(F.min(F.struct(*turn)).alias("_f")).select(*(F.col(f"_f.{t}").alias(t) for t in turn), F.lit(True).alias(mark))
    return df.join(firsts, list(turn), "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def upsert_plan(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, ord, decision, target_id): what becomes of each row of a batch that arrives in order. [DM-01, JN-01..03, WN-04]

    stored: id, form_key, home_key, form_url. batch: the same and ord. Keys are '' (or null) where a row has no such page.
    The loop "insert unless the form is known; if only the home page is known, upgrade a stored row without a form" is two
    first-row marks: a row that survives the form check always adds its form, and the first survivor of a home page inserts.
    Only candidates and their targets are ranked.
    decision: insert, upgrade (target_id says which row), or duplicate. Among possible targets the stored ones come first,
    by id, then the ones just inserted, by order; the k-th candidate takes the k-th target.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    cols = [F.col("id"), blank("form_key").alias("f"), blank("home_key").alias("h"), blank("form_url").alias("url")]
    old, new = stored.select(*cols), batch.select(*cols, "ord")
    new = new.withColumn("turn", F.row_number().over(W.partitionBy("ord", "id").orderBy("f", "h", "url")))  # of repeated rows one is first
    marked = marked_known(marked_known(new, old, "f", "f_known"), old, "h", "h_known")
    judged = with_first(marked, "f", ["ord", "id", "turn"], "f_first").withColumn("survives", (F.col("f") == "") | (F.col("f_first") & ~F.col("f_known")))
    judged = with_first(judged, "h", ["ord", "id", "turn"], "h_first", F.col("survives"))
    inserts = F.col("survives") & ((F.col("h") == "") | (F.col("h_first") & ~F.col("h_known")))
    judged = judged.withColumn("state", F.when(inserts, "insert").when(F.col("survives") & (F.col("f") != "") & (F.col("url") != ""), "candidate").otherwise("duplicate"))
    targets = old.where("url = '' AND h <> ''").select("h", F.col("id").alias("target_id"), F.lit(0).alias("late"), F.lit(0).cast("bigint").alias("o"))
    targets = targets.unionAll(judged.where("state = 'insert' AND url = '' AND h <> ''").select("h", "id", F.lit(1), F.col("ord").cast("bigint")))
    targets = targets.withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("late", "o", "target_id"))).select("h", "k", "target_id")
    candidates = judged.where("state = 'candidate'").withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("ord", "id")))
    upgraded = candidates.join(targets, ["h", "k"], "left").select("id", "ord", F.when(F.col("target_id").isNotNull(), "upgrade").otherwise("duplicate").alias("decision"), "target_id")
    rest = judged.where("state <> 'candidate'").select("id", "ord", F.col("state").alias("decision"), F.lit(None).cast("string").alias("target_id"))
    return rest.unionByName(upgraded)


def upsert_counts(plan: DataFrame) -> DataFrame:
    """(added, upgraded, duplicates) of a plan. [AG-11]"""
    n = lambda d: F.count_if(F.col("decision") == d)
    return plan.agg(n("insert").alias("added"), n("upgrade").alias("upgraded"), n("duplicate").alias("duplicates"))


def upserted(stored: DataFrame, batch: DataFrame, plan: DataFrame) -> DataFrame:
    """The stored table after a plan: upgraded rows get form fields, and phone, e-mail and address where they had none; inserts follow. [DM-01, DM-02]"""
    kept = [c for c in stored.columns if c in batch.columns]
    ups = plan.where("decision = 'upgrade'").join(batch.drop("ord"), "id").select(F.col("target_id").alias("id"), *(F.col(c).alias(f"new_{c}") for c in ("form_url", "form_key", "form_type", "phone", "email", "address")))
    both = stored.join(ups, "id", "left")
    hit = F.col("new_form_url").isNotNull()
    for c in ("form_url", "form_key", "form_type"):
        both = both.withColumn(c, F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)))
    for c in ("phone", "email", "address"):
        both = both.withColumn(c, F.when(hit, or_else(F.col(c), F.coalesce(F.col(f"new_{c}"), F.lit("")))).otherwise(F.col(c)))
    added = batch.join(plan.where("decision = 'insert'").select("id"), "id", "left_semi")
    return both.select(stored.columns).unionByName(added.select(kept), allowMissingColumns=True)
