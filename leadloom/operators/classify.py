"""Rule classifiers, re-classification of stored rows, and the hook for a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import lists, urls
from leadloom.operators.dedup import first_wins, resolved_type


def by_words(text: Column) -> Column:
    """More booking words than inquiry words: booking; any inquiry word: inquiry; else unknown. Null reads as ''. [CL-17]"""
    t = F.lower(F.coalesce(text, F.lit("")))
    a, b = urls.count_of(t, lists.RULE_BOOKING), urls.count_of(t, lists.RULE_INQUIRY)
    return F.when(a > b, "booking").when(b > 0, "inquiry").otherwise("unknown")


def confidence(label: Column) -> Column:
    return F.when(label == "unknown", 0.3).otherwise(0.7)


def by_page(text: Column, html: Column) -> Column:
    """Two booking words in the text or the HTML: booking; any inquiry word in the text: inquiry; else unknown. [CL-18]"""
    t, h = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(html, F.lit("")))
    booking = urls.count_of(F.concat_ws("\x1f", t, h), lists.PAGE_BOOKING)
    return F.when(booking >= 2, "booking").when(urls.count_of(t, lists.PAGE_INQUIRY) > 0, "inquiry").otherwise("unknown")


def reclassified(df: DataFrame, url: str = "form_url", kind: str = "form_type") -> DataFrame:
    """Stored rows with their type by the rules of today: chat links, booking hosts; one scheduling host keeps its contact pages. [RC-01]"""
    host, path = urls.host_key(F.col(url)), F.lower(urls.path(F.col(url)))
    scheduling = urls.on_hosts(host, ["coubic.com"])
    booking = (urls.on_hosts(host, [h for h in lists.BOOKING_HOSTS if h != "coubic.com"])) | (scheduling & path.rlike("/(book|express)"))
    new = F.when(urls.is_line(F.col(url)), "LINE").when(booking & F.coalesce(kind, F.lit("")).isin("inquiry", "unknown", ""), "reservation").otherwise(F.col(kind))
    return df.withColumn("new_type", new)


def rekeyed(df: DataFrame, url: str, order: str) -> DataFrame:
    """Stored rows with a fresh key, the later of two equal ones dropped; rows without a form stay. [RC-02]"""
    return first_wins(df.withColumn("fresh_key", urls.store_key(F.col(url))), ["fresh_key"], [order])


def model_candidates(df: DataFrame, has_link: str, hint: str) -> DataFrame:
    """The rows a model may look at: with a contact link, not decided by a rule. [FL-25]"""
    return df.where(F.col(has_link) & ~F.coalesce(F.col(hint).isin("LINE", "booking", "recruitment"), F.lit(False)))


def by_model(df: DataFrame, text: str, hint: str, classify: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """The hint, or what a model makes of the text: its answers outside the known types keep the hint. No model: unchanged. [LM-01]"""
    if classify is None:
        return df.withColumn("type", F.col(hint))
    answer = F.pandas_udf(classify, "string")(F.col(text))
    return df.withColumn("_a", answer).withColumn("type", F.when(F.col("_a").isin("inquiry", "booking", "LINE", "recruitment", "unknown"), F.col("_a")).otherwise(F.col(hint))).drop("_a")


def json_answer(reply: Column) -> Column:
    """The type in the first JSON object of a reply, 'unknown' if there is none. [MD-09]"""
    kind = F.get_json_object(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*?\})", 1), "$.type")
    return F.when(kind.isin("inquiry", "booking", "LINE", "recruitment", "unknown"), kind).otherwise("unknown")


__all__ = ["by_model", "by_page", "by_words", "confidence", "json_answer", "model_candidates", "reclassified", "rekeyed", "resolved_type"]
