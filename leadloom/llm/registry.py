"""The subpackage's queries by name, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import address, canonical, encode, history, leak, looks, names, spans, survivor
from leadloom.llm.sql import SQL
from leadloom.sources.tables import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"phone": survivor.usable_phone(F.col("phone")), "email": survivor.usable_email(F.col("email")), "form_type": survivor.usable_type(F.col("form_type"))}
    return survivor.survivors(table(spark, sf_dir, "companies"), "normalized_form_url", "id", "collected_at", fields)


def p2_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.consensus(table(spark, sf_dir, "companies"), "normalized_form_url", "id", "name")


def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, keep_id, value_id, value): the consensus of the usable phones, e-mails and form types, newer rows weighing more."""
    usable = {"phone": survivor.usable_phone, "email": survivor.usable_email, "form_type": survivor.usable_type}
    rows = table(spark, sf_dir, "companies").withColumns({f: F.when(of(F.col(f)), F.col(f)) for f, of in usable.items()})
    parts = [survivor.consensus(rows, "normalized_form_url", "id", f, survivor.recency(F.col("collected_at"))).select(F.lit(f).alias("field"), "*") for f in usable]
    return functools.reduce(DataFrame.unionAll, parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.look_alikes(spread(table(spark, sf_dir, "companies"), "id"), "id", ["name", "phone", "address"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.look_classes(spread(table(spark, sf_dir, "companies"), "id"), "id", ["name", "phone", "address"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "sheet_row").where(F.col("id").isNull())
    stored = {c: F.col(c) for c in ("name", "industry", "area", "phone", "address")}
    hand = {"name": F.col("会社名"), "industry": F.col("業種"), "area": F.col("エリア"), "phone": F.col("電話番号"), "address": F.col("住所")}
    return names.same_organisations(spread(table(spark, sf_dir, "companies"), "id"), typed, "id", "row_no", stored, hand)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeats(spread(table(spark, sf_dir, "companies"), "id"), spread(table(spark, sf_dir, "company_batches"), "id"), "id", {"form": "form_url", "home": "hp_url"}, "ord")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "sheet_row").where(F.col("id").isNull())
    return address.same_places(spread(table(spark, sf_dir, "companies"), "id"), typed, "id", "row_no", "address", "住所")


def _urls() -> list:
    return [canonical.canonical_url(F.col("form_url")), canonical.canonical_url(F.col("hp_url"))]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copy_pairs(table(spark, sf_dir, "companies"), "id", _urls())


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copies(table(spark, sf_dir, "companies"), "id", _urls())


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copy_members(table(spark, sf_dir, "companies"), "id", _urls())


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, digest): the MD5 of what the ids of each text decode to."""
    text = encode.decode(p8_ids(spark, sf_dir), "doc_id")
    return text.select("doc_id", F.md5("text").alias("digest"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id")
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.shared_amounts(table(spark, sf_dir, "documents"), "doc_id")
    return out.select(F.col("doc").alias("doc_id"), "spans", "shared")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_names, p2_fields, p3_found, p3_classes, p4_found, p5_found, p6_found, p7_found, p7_copies, p7_members, p8_ids, p8_decoded, p9_found, p10_found, p10_shared)}


def oracle_sql() -> dict[str, str]:
    return SQL
