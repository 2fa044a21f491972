"""Queries of what comes in and goes out: configuration, callbacks, appended and exported tables, keyword lists, defaults, small texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import contact
from leadloom.functions.text import missing
from leadloom.operators import catalog, classify, reports, runs, search
from leadloom.sources import export, readers
from leadloom.sources.tables import cut, scratch, table
from leadloom.streaming import jobs

_RECORD = T.StructType().add("name", "string").add("hp_url", "string").add("form_url", "string").add("phone", "string")


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies")


def _last(c: str = "id"):
    """The code of an id's last character: what kind of made-up input a row gets."""
    return F.ascii(F.substring(c, -1, 1))


def config_read(spark, d):
    """The runs as one JSON configuration, written and read again."""
    path = scratch(spark)
    t = F.col("search_target")
    one = table(spark, d, "project_runs").select(F.struct("id", t["industry"].alias("industry"), t["areas"].alias("areas"), (F.col("status") == "success").alias("enabled")).alias("r"))
    one.agg(F.sort_array(F.collect_list("r")).alias("runs")).coalesce(1).write.json(path)  # 360 rows at any scale: a configuration
    r = readers.read_config(spark, path).select(F.explode("runs").alias("r"))
    return r.select("r.id", "r.industry", F.coalesce(F.size("r.areas"), F.lit(0)).cast("bigint").alias("areas"), "r.enabled")


def config_edited(spark, d):
    """A configuration after a run is added, one removed, one switched."""
    number = F.regexp_replace(F.substring("id", 10, 8), "-", "")
    c = table(spark, d, "projects").select(F.concat(F.lit("run-"), number).alias("id"), F.col("name").alias("label"), F.col("description").isNotNull().alias("enabled"))
    out = runs.toggled(runs.without(runs.with_new(c, {"label": "新規", "enabled": True}), "run-0105001"), "run-0113002")
    return out.select("id", "label", "enabled")


def callbacks(spark, d):
    """Each run's rows as a callback body, some broken, parsed and checked record by record."""
    record = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "hp_url", "form_url", "phone")))
    body = F.when(_last() % 7 == 0, F.lit('[{"name": "broken')).otherwise(F.to_json(F.array(record, F.struct(F.lit(" ").alias("name"), F.lit("").alias("hp_url"), F.col("id").alias("form_url"), F.lit("").alias("phone")))))
    return readers.parsed_records(_companies(spark, d).select("id", body.alias("body")), "body", _RECORD).select("id", "name", "hp_url", "phone")


def search_jobs(spark, d):
    """Jobs with their result rows, which count once the job is done; written as JSON and read again."""
    c = _companies(spark, d).select("id", F.when(_last() % 2 == 0, "done").otherwise("running").alias("status"), F.array(F.struct(F.col("hp_url").alias("link"), F.col("name").alias("title"))).alias("result_items"))
    path = scratch(spark)
    c.write.json(path)
    again = readers.finished_items(spark.read.schema(c.schema).json(path))
    return again.select("id", "status", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("items")[0]["link"], F.lit("")).alias("link"))


def arrivals(spark, d):
    """Run requests that arrive as files, taken in as a stream; a run twice in the folder is taken once."""
    path, out = scratch(spark), scratch(spark)
    b = table(spark, d, "company_batches").select("id", "run_id", "ord")
    for part in (b, b.where("ord % 5 = 0")):
        part.write.mode("append").json(f"{path}/in")
    stream = jobs.incoming(spark, f"{path}/in", b.schema)
    stream.writeStream.foreachBatch(jobs.append_new(out, "id", "ord")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("run_id").agg(F.count("*").alias("n"))


def appended(spark, d):
    """Batches appended to a table, one of them twice."""
    path = scratch(spark)
    b = table(spark, d, "company_batches").select("id", "ord", "name")
    for name, part in (("a", b.where("ord % 2 = 0")), ("b", b.where("ord % 2 = 1")), ("a", b.where("ord % 2 = 0"))):
        reports.append(part, path, name)
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


def control_table(spark, d):
    """A control table replaced twice, read by its pointer."""
    path = scratch(spark)
    p = table(spark, d, "projects").select("id", "name")
    for df in (p, p.where("id > 'proj-20260110'")):
        readers.write_control(df, path)
    readers.drop_versions(spark, path)
    return readers.read_control(spark, path)


def csv_export(spark, d):
    """The exported file's lines, how many of them are headers, and how many parts begin with a byte-order mark."""
    path = scratch(spark)
    export.write_csv(_companies(spark, d), path, ["id"])
    lines = spark.read.csv(path, multiLine=True, escape='"')
    marked = spark.read.format("binaryFile").load(path).agg(F.count_if(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))
    head = F.endswith("_c0", F.lit("会社名")) & F.endswith("_c13", F.lit("実行ID"))
    return lines.agg(F.count_if(F.coalesce(head, F.lit(False))).alias("headers"), F.count("*").alias("lines")).crossJoin(marked)  # one row each


def camel_rows(spark, d):
    return reports.camel(_companies(spark, d).select("id", "hp_url", "form_url", "normalized_form_url", "collected_at"))


def defaulted(spark, d):
    return catalog.with_defaults(_companies(spark, d).select("id", "status", "form_type", "phone", "notes"), {"status": "未送信", "form_type": "unknown", "phone": "", "notes": ""})


def request_defaults(spark, d):
    """Requests of runs with what they leave out filled in; a missing list of keywords is the industry."""
    t = F.col("search_target")
    r = table(spark, d, "project_runs").select("id", t["industry"].alias("industry"), t["area"].alias("area"), t["keywordMode"].alias("mode"), t["searchMode"].alias("search"), t["keywords"].alias("words"))
    r = catalog.with_defaults(r, {"mode": "or", "search": "area", "area": "東京都"})
    return r.select("id", "mode", "search", "area", F.array_join(F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, F.col("words")).otherwise(F.array("industry")), ",").alias("words"))


def keyword_lists(spark, d):
    typed = F.concat_ws(" ,", "industry", F.coalesce("area", F.lit("")), F.lit(" "), "form_type")
    return _companies(spark, d).select("id", F.array_join(search.keyword_list(typed), "|").alias("words"))


def _word_lists():
    """A few proposed lists of keywords, by the kind of a row."""
    given = [["歯科", "歯医者"], ["美容室", "美容院", "ヘアサロン"], ["整骨院"], [], [" ", "カフェ"], ["税理士", "会計事務所", "税理士"]]
    return F.element_at(F.array(*(F.array(*map(F.lit, w)).cast("array<string>") for w in given)), _last() % len(given) + 1)


def proposed_words(spark, d):
    c = _companies(spark, d).where(~missing(F.col("industry"))).select("id", "industry", _word_lists().alias("w"))
    return c.select("id", F.array_join(search.keywords_for(F.col("industry"), F.col("w"), F.lit(3)), "|").alias("words"))


def words_once(spark, d):
    return _companies(spark, d).select("id", F.array_join(search.without_synonyms(F.filter(_word_lists(), lambda w: F.trim(w) != "")), "|").alias("words"))


def merged_contacts(spark, d):
    """The sheet's contacts before the store's, and the other way round."""
    s = table(spark, d, "sheet_row").where("id IS NOT NULL").groupBy("id").agg(F.max_by("電話番号", "row_no").alias("p"))
    c = _companies(spark, d).join(s, "id")
    return c.select("id", contact.merged(F.col("p"), F.col("phone")).alias("newer"), contact.merged(F.col("p"), F.col("phone"), True).alias("gaps"))


def model_replies(spark, d):
    """Replies of a model: an object, one within other words, a type that isn't known, none."""
    reply = F.element_at(F.array(F.concat(F.lit('{"type": "'), F.coalesce("form_type", F.lit("")), F.lit('"}')), F.lit('Sure: {"type": "booking", "confidence": 1} ok'), F.lit('{"type": "shop"}'), F.lit("no")), _last() % 4 + 1)
    return _companies(spark, d).select("id", classify.json_answer(reply).alias("type"))


def _toy_model(texts):
    """A stand-in for a model in tests of the hook."""
    return texts.map(lambda t: "booking" if t and "送信" in t else "?")


def model_types(spark, d):
    return classify.by_model(_companies(spark, d).select("id", "notes", "form_type"), "notes", "form_type", _toy_model).select("id", F.coalesce("type", F.lit("")).alias("type"))


def model_candidates(spark, d):
    c = _companies(spark, d).select("id", (~missing(F.col("form_url"))).alias("linked"), "form_type")
    return classify.model_candidates(c, "linked", "form_type").select("id")


def random_ids(spark, d):
    """(rows, ids): how many different ids rows get; the ids themselves are random."""
    # written down first: an id that is computed twice is two ids
    rows = cut(reports.with_ids(_companies(spark, d).select("name"), "cmp-"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.startswith("id", F.lit("cmp-"))).alias("prefixed"))


def near_points(spark, d):
    """Points made of ids, as text, and whether they are within 20 km of a station."""
    lat, lng = 35.0 + _last() / 100.0, 139.0 + F.ascii(F.substring("id", -2, 1)) / 100.0
    return _companies(spark, d).select("id", reports.point_text(lat, lng).alias("point"), search.within(lat, lng, 35.681236, 139.767125, 20.0).alias("near"))


def rekeyed(spark, d):
    """Which rows stay if stored keys are made anew and the later of two equal ones goes."""
    return classify.rekeyed(_companies(spark, d), "form_url", "id").select("id", "fresh_key")


def query_limits(spark, d):
    t = F.col("search_target")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return table(spark, d, "project_runs").select("id", search.limit_column(t["maxResults"], size(t["areas"]), size(t["keywords"])).alias("most"))


def capped_queries(spark, d):
    """The rows of each industry and area as the results of one query, whole pages of 20 up to 30."""
    c = _companies(spark, d).select("id", "industry", "area")
    return search.capped_results(c, ["industry", "area"], "id", F.lit(30)).select("id")


def concatenated_parts(spark, d):
    c = _companies(spark, d).select("id", "industry")
    return search.concatenated([c.where(F.col("industry") == w) for w in ("歯科", "カフェ", "歯科")]).select("id", "part")


def areas_with_failures(spark, d):
    """Areas of which some can't be looked up: those pass."""
    typed = table(spark, d, "sheet_row").select("row_no", F.concat(F.col("エリア"), F.when(F.col("row_no") % 3 == 0, "x").otherwise("")).alias("area"))
    known = catalog.facet(_companies(spark, d), "area")
    return reports.known_areas(typed, "area", known, F.col("row_no") % 2 == 0).select("row_no", "valid")


def grid_without(spark, d):
    """Counts of the rows without a form, asked for those without a phone too."""
    return catalog.counts(_companies(spark, d), catalog.Filter(has_form=False, has_phone=False))


def update_affected(spark, d):
    return catalog.affected(_companies(spark, d), catalog.Filter(status="未送信", has_form=True).condition())


def maintained_idle(spark, d):
    """The store after maintenance while no job is busy, and while some are."""
    c = _companies(spark, d)
    old = catalog.expired(c, "2026-04-01 00:00:00", ["送信済み", "スキップ", "エラー"])
    jobs = table(spark, d, "project_runs")
    parts = [catalog.maintained(c, jobs, busy, old) for busy in (["no such status"], ["success", "running"])]
    return search.concatenated([p.agg(F.count("*").alias("n")) for p in parts])


def _two_runs(spark, d):
    """The first ended and the first unfinished run, by id."""
    r = table(spark, d, "project_runs")
    return [r.where(c).agg(F.min("id")).first()[0] for c in ("status NOT IN ('running', 'pending')", "status IN ('running', 'pending')")]


def runs_removed(spark, d):
    """(run_id, affected) of two runs that are to go; one is busy and stays."""
    return catalog.without_runs(_companies(spark, d), table(spark, d, "project_runs"), _two_runs(spark, d))[1]


def rows_after_removal(spark, d):
    left = catalog.without_runs(_companies(spark, d), table(spark, d, "project_runs"), _two_runs(spark, d))[0]
    return left.groupBy("run_id").agg(F.count("*").alias("n"))


def next_project_by_count(spark, d):
    return runs.next_by_count(table(spark, d, "projects"), "id", "proj-202601")


def execution_tokens(spark, d):
    """The runs as executions whose nodes report tokens, two results to a node; some bodies are broken."""
    use = lambda a, b: F.array(F.array(F.struct(F.struct(F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens")).alias("usage")).alias("json"))))
    item = lambda a, b: F.struct(F.struct(use(a, b).alias("main")).alias("data"))
    nodes = F.struct(F.array(item(F.col("tokens_input"), F.col("tokens_output")), item(F.lit(10), F.lit(None).cast("int"))).alias("first"), F.array(item(F.lit(1), F.lit(2))).alias("second"))
    body = F.when(_last() % 5 == 0, "{}").when(_last() % 5 == 1, "?").otherwise(F.to_json(nodes))
    out = runs.node_tokens(table(spark, d, "project_runs").select("id", body.alias("body")), "id", "body")
    return out.select("id", F.coalesce("tokens_input", F.lit(-1)).alias("tokens_input"), F.coalesce("tokens_output", F.lit(-1)).alias("tokens_output"))


QUERIES = [
    config_read, config_edited, callbacks, search_jobs, arrivals, appended, control_table, csv_export, camel_rows, defaulted, request_defaults, keyword_lists, proposed_words, words_once,
    merged_contacts, model_replies, model_types, model_candidates, random_ids, near_points, rekeyed, query_limits, capped_queries, concatenated_parts, areas_with_failures, grid_without,
    update_affected, maintained_idle, runs_removed, rows_after_removal, next_project_by_count, execution_tokens,
]
