"""Search requests: expansion into queries, keyword lists, and what is skipped in the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions import lists, urls


def keyword_list(c: Column) -> Column:
    """A comma list as an array without blanks. [TX-19]"""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")


def keyword_groups(words: Column, together: bool) -> Column:
    """One query per keyword, or one for all of them. [TX-18, JN-11]"""
    return F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(words) if together else words


def queries(requests: DataFrame, words: str, area: str, suffixes: Sequence[str] = tuple(lists.SUFFIXES), pages: int = 10, together: bool = False) -> DataFrame:
    """Each request's queries: keyword by suffix by page, in that order. [JN-11, TX-17, SC-12]

    Adds keyword, suffix, page, query and ord. Explodes constant arrays next to each row; there is no join.
    """
    out = requests.select("*", F.posexplode(keyword_groups(F.col(words), together)).alias("_k", "keyword"))
    out = out.select("*", F.posexplode(F.array(*map(F.lit, suffixes))).alias("_s", "suffix"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.lit(pages)).cast("array<bigint>")).alias("page"))
    text = F.concat_ws(" ", "keyword", area, F.nullif("suffix", F.lit("")))
    return out.withColumn("query", text).withColumn("ord", ((F.col("_k") * len(suffixes) + F.col("_s")) * pages + F.col("page") - 1).cast("bigint")).drop("_k", "_s")


def excluded_query(keyword: Column, area: Column, extra: Sequence[str] = ()) -> Column:
    """The query text with its exclusions, each once. [TX-17]"""
    words = list(dict.fromkeys([*lists.EXCLUSIONS, *extra]))
    return F.concat(F.trim(F.concat_ws(" ", keyword, area, F.lit("お問い合わせ"))), F.lit("".join(f" -{w}" for w in words)))


def expanded_areas(requests: DataFrame, area: str, parts: DataFrame) -> DataFrame:
    """Each request once per part of its area, or once as it is. parts: (area, part, ord). [JN-12..14]

    The join is a left join on the area; Spark broadcasts the parts where they are small.
    """
    return requests.join(parts.select(F.col("area").alias(area), "part", "ord"), area, "left").withColumn("part", F.coalesce("part", area)).withColumn("ord", F.coalesce("ord", F.lit(0)))


def limit_per_query(most: int, areas: int, words: int) -> int:
    """How many results one query may give; 60 if there is no limit. [SL-06]"""
    return 60 if not most else -(-most // max(areas, 1)) if words <= 1 else -(-most // (max(areas, 1) * words))


def limit_column(most: Column, areas: Column, words: Column) -> Column:
    """How many results one query of a request may give: its share of `most`, rounded up; 60 where there is no limit. [SL-06]"""
    return F.when(F.coalesce(most, F.lit(0)) <= 0, 60).otherwise(F.ceil(most / F.greatest(areas, F.lit(1)) / F.greatest(words, F.lit(1)))).cast("bigint")


def capped_results(results: DataFrame, query: Sequence[str], order: str, limit: Column, page: int = 20) -> DataFrame:
    """The results of each query up to its limit, whole pages. [SL-06, SC-14]"""
    n = F.row_number().over(W.partitionBy(*query).orderBy(order))
    return results.withColumn("_n", n).where(F.floor((F.col("_n") - 1) / page) * page < limit).drop("_n")


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    """The results of several keywords one after the other: with `part`, the place of their keyword; nothing is merged. [SO-02]"""
    numbered = [df.withColumn("part", F.lit(i).cast("bigint")) for i, df in enumerate(parts)]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def organic(results: DataFrame, link: str, skipped: Sequence[str] = tuple(lists.SKIPPED_DOMAINS)) -> DataFrame:
    """The results with a host that isn't of a skipped domain, with that host. [FL-16, FL-17, UR-04]"""
    return results.withColumn("host", urls.raw_host(F.col(link))).where(F.col("host") != "").where(~urls.on_hosts(F.col("host"), list(skipped)))


def not_aggregated(results: DataFrame, link: str) -> DataFrame:
    """The results whose host holds no aggregator's name; those without a host are left out. [FL-18]"""
    return results.withColumn("host", urls.host(F.col(link))).where((F.col("host") != "") & ~urls.holds_host(F.col("host"), lists.AGGREGATORS))


def company_name(title: Column) -> Column:
    """A result's title up to its separators: the longest part if one has more than five characters, else the first. [PR-12]"""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s*[|｜\-–—]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    longest = F.array_max(F.transform(parts, F.length))
    first_long = F.try_element_at(F.filter(parts, lambda p: F.length(p) == longest), F.lit(1))
    return F.coalesce(F.when(longest > 5, first_long).otherwise(F.try_element_at(parts, F.lit(1))), F.lit(""))


def clean_title(title: Column) -> Column:
    """A title without what follows a bar or dash, and without notes in lenticular brackets. [PR-13]"""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*[|｜]\s*.+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*[-–—]\s*.+$", ""), r"【[^】]*】", ""))


def without_synonyms(words: Column) -> Column:
    """Keywords in order without synonyms of ones before; of two synonyms of one industry the later stays. [CL-21]

    A fold over the array: the state holds what is kept and what is refused.
    """
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("refused"))

    def step(state: Column, word: Column) -> Column:
        kept, refused = F.array_append(state["kept"], word), state["refused"]
        for name, others in lists.SYNONYMS.items():
            others_ = F.array(*map(F.lit, others))
            near = (word == name) | F.contains(word, F.lit(name)) | F.contains(F.lit(name), word)
            is_other = F.array_contains(others_, word)
            kept = F.when(is_other, F.filter(kept, lambda k: ~F.array_contains(F.array_except(others_, F.array(word)), k))).otherwise(kept)
            refused = F.when(near | is_other, F.array_union(refused, others_)).otherwise(refused)
        passed = F.struct(kept.alias("kept"), refused.alias("refused"))
        return F.when(F.array_contains(state["refused"], word), state).otherwise(passed)

    return F.aggregate(words, empty, step, lambda s: s["kept"])


def keywords_for(industry: Column, words: Column, most: Column) -> Column:
    """Proposed keywords made usable: no blanks, at most so many, the industry among them, no synonyms. [CL-22, PR-09]"""
    given = F.slice(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.trim(w) != ""), F.lit(1), most)
    there = F.exists(given, lambda w: F.contains(w, industry) | F.contains(industry, w))
    full = F.when(there, given).otherwise(F.array_prepend(given, industry))
    return F.when(F.size(given) > 0, F.slice(without_synonyms(full), F.lit(1), most)).otherwise(F.array(industry))


def density(area: Column, high: Sequence[str], middle: Sequence[str]) -> Column:
    """(tier) of an area by two lists; a prefecture counts as dense, anything else as thin. [CL-20]"""
    return F.when(area.isin(list(high)), "high").when(area.isin(list(middle)), "medium").when(area.rlike("[都道府県]$"), "high").otherwise("low")


def most_keywords(tier: Column) -> Column:
    return F.when(tier == "high", 4).when(tier == "medium", 2).otherwise(1)


def within(lat: Column, lng: Column, lat0: float, lng0: float, km: float) -> Column:
    """Whether a point lies in a circle on the earth (an extension). [MD-11]"""
    a, b = F.radians(lat), F.radians(F.lit(lat0))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng) - F.radians(F.lit(lng0))) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h)) <= km
