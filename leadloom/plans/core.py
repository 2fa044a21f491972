"""Queries over the test tables, one or more per operator. Their SQL is in `core_sql`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions import contact, html, lists, urls
from leadloom.functions.text import missing
from leadloom.operators import catalog, classify, dedup, limits, pages, reports, runs, search
from leadloom.sources import export
from leadloom.sources.tables import spread, table

NOW = "2026-07-01 00:00:00"
HIGH, MIDDLE = ["港区", "中央区", "広島市"], ["長野市", "静岡市"]


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "project_runs")


def _first_ids(df: DataFrame, column: str, n: int) -> list[str]:
    """The `n` smallest ids of a column: what a query asks for, whatever the data."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n).collect()]


def _html(c: str = "c") -> Column:
    """A company's row as a small home page."""
    x = lambda n: F.coalesce(F.col(n), F.lit(""))
    return F.concat(
        F.lit("<html><head><title>"), x("name"), F.lit(" &amp; お問い合わせ</title><script>var a = 1;</script></head><body><h1>"), x("industry"), F.lit("</h1>\n<nav><a href=\""),
        x("form_url"), F.lit("\">お問い合わせ</a></nav><h2> "), x("area"), F.lit(" </h2><p>TEL: "), x("phone"), F.lit(" FAX: 03-9999-0000</p><p>住所："), x("address"),
        F.lit("</p><p>"), x("notes"), F.lit("&nbsp;</p><footer><a href=\"mailto:"), x("email"), F.lit("\">mail</a></footer></body></html>"),
    )


# addresses


def url_keys(spark, d):
    f, h = F.col("form_url"), F.col("hp_url")
    return spread(_companies(spark, d), "id").select(
        "id", urls.store_key(f).alias("store_key"), urls.page_key(f).alias("page_key"), urls.host_key(h).alias("host"), urls.raw_host(h).alias("raw_host"),
        urls.without_tracking(f).alias("stripped"), urls.link_key(f).alias("link_key"), urls.display(f).alias("display"), urls.tried_path(f).alias("tried_path"),
    )


def url_flags(spark, d):
    f, h = F.col("form_url"), F.col("hp_url")
    reads = F.coalesce(urls.decoded(f), F.lit(""))
    return _companies(spark, d).select(
        "id", urls.is_line(f).alias("line"), urls.is_internal(f, h).alias("internal"), urls.contact_subdomain(f).alias("contact_host"), urls.same_page(f, h).alias("same_page"),
        urls.fetchable(f).alias("fetchable"), urls.holds_any(reads, lists.JAPANESE_PATH_WORDS).alias("japanese"), F.lower(f).rlike(lists.CONTACT_PATH).alias("contact_path"),
    )


def stored_keys_agree(spark, d):
    """How many stored keys the key function gives again."""
    c = _companies(spark, d).select(urls.store_key(F.col("form_url")).alias("k"), F.coalesce("normalized_form_url", F.lit("")).alias("f"), urls.store_key(F.col("hp_url")).alias("l"), F.coalesce("normalized_hp_url", F.lit("")).alias("h"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("k") == F.col("f")).alias("form_agrees"), F.count_if(F.col("l") == F.col("h")).alias("home_agrees"))


def host_counts(spark, d):
    return _companies(spark, d).groupBy(urls.host_key(F.col("form_url")).alias("host")).agg(F.count("*").alias("n"))


def host_top(spark, d):
    return host_counts(spark, d).where("host <> ''").orderBy(F.desc("n"), "host").limit(20)


# the list


def grid_page(spark, d):
    f = catalog.Filter(industry="歯科", has_form=True)
    return catalog.page(_companies(spark, d), f, "name", False, 2, 50).select("id", "name", "area", "form_url")


def grid_search(spark, d):
    return catalog.rows(_companies(spark, d), catalog.Filter(search="Hair", has_phone=True, status="未送信")).select("id", "name", "phone")


def grid_counts(spark, d):
    return catalog.counts(_companies(spark, d), catalog.Filter(area="東京都"))


def grid_in_runs(spark, d):
    return catalog.counts(_companies(spark, d), catalog.Filter(run_ids=_first_ids(_companies(spark, d), "run_id", 2)))


def facet_industry(spark, d):
    return catalog.facet(_companies(spark, d), "industry")


def facet_area(spark, d):
    return catalog.facet(_companies(spark, d), "area")


def status_counts(spark, d):
    return catalog.group_counts(_companies(spark, d), "status", "不明")


def type_counts(spark, d):
    return catalog.group_counts(_companies(spark, d), "form_type", "unknown")


def type_by_industry(spark, d):
    return _companies(spark, d).cube("industry", "form_type").agg(F.count("*").alias("n"))


def project_stats(spark, d):
    return catalog.project_stats(table(spark, d, "projects"), _runs(spark, d), _companies(spark, d))


def form_keys(spark, d):
    return catalog.key_set(_companies(spark, d), "normalized_form_url")


def home_keys(spark, d):
    return catalog.key_set(_companies(spark, d), "normalized_hp_url", distinct=False)


def localised_rows(spark, d):
    return catalog.localised(_companies(spark, d), with_id=True)


def imported_rows(spark, d):
    return catalog.from_localised(table(spark, d, "sheet_row")).select("name", "form_url", "status", "run_id", "imported_from_sheets")


def bulk_update(spark, d):
    changed = catalog.updated(_companies(spark, d), F.col("industry") == "カフェ", {"status": "スキップ"})
    return changed.groupBy("status").agg(F.count("*").alias("n"))


def run_deleted(spark, d):
    return catalog.deleted(_companies(spark, d), F.col("run_id").isin(_first_ids(_companies(spark, d), "run_id", 1))).groupBy("project_id").agg(F.count("*").alias("n"))


def pruned(spark, d):
    c = _companies(spark, d)
    return catalog.deleted(c, catalog.expired(c, "2026-04-01 00:00:00", ["送信済み", "スキップ", "エラー"])).select("id")


def collected_at(spark, d):
    return _companies(spark, d).select("id", F.coalesce(F.unix_millis(catalog.instant(F.col("collected_at"))), F.lit(-1)).alias("ms"))


def csv_lines(spark, d):
    return export.csv_lines(_companies(spark, d))


def tab_counts(spark, d):
    return export.tabs(_companies(spark, d), _runs(spark, d)).groupBy("tab").agg(F.count("*").alias("n"))


# runs


def run_history(spark, d):
    return runs.history(_runs(spark, d), table(spark, d, "projects"))


def run_tree(spark, d):
    return runs.tree_ids(_runs(spark, d))


def run_children(spark, d):
    return runs.children(_runs(spark, d))


def batch_rollup(spark, d):
    """Sums that are null come out as -1."""
    sums = ["tokens_input", "tokens_output", "raw_search_count"]
    return runs.rolled_up(_runs(spark, d)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in sums})


def rollup_needed(spark, d):
    return runs.roll_up_needed(_runs(spark, d)).select("id", "status", "items_written")


def conversion(spark, d):
    return runs.conversion(_runs(spark, d))


def success_share(spark, d):
    return runs.success_share(_runs(spark, d))


def queue_position(spark, d):
    return runs.queue_position(_runs(spark, d), "pending")


def newest_runs(spark, d):
    return runs.keep_newest(_runs(spark, d).where("status IN ('success', 'completed', 'error')"), 3, ["project_id"], F.coalesce("completed_at", "created_at")).select("id", "project_id")


def stale_runs(spark, d):
    return runs.stale(_runs(spark, d), NOW, {"running": "2 HOURS", "pending": "24 HOURS"})


def next_project(spark, d):
    return runs.next_number(table(spark, d, "projects"), "id", "proj-20260105-")


def token_totals(spark, d):
    return runs.token_totals(_runs(spark, d))


def actual_counts(spark, d):
    return runs.actual_counts(_runs(spark, d), _companies(spark, d))


def child_targets(spark, d):
    t = runs.child_targets(_runs(spark, d))
    return t.select("parent_id", "ord", F.col("target.area").alias("area"), F.col("target.industry").alias("industry"))


def retries(spark, d):
    return runs.retries(_runs(spark, d)).select("run_id", "industry", "area", F.array_join("keywords", ",").alias("keywords"), "max_results")


def file_names(spark, d):
    return _runs(spark, d).select("id", export.file_name(F.col("label"), "企業リスト", "2026-07-01").alias("name"), export.tab_title(F.col("label")).alias("tab"))


# searches


def _requests(spark, d):
    t = F.col("search_target")
    return _runs(spark, d).select("id", t["keywords"].alias("words"), t["area"].alias("area"), t["industry"].alias("industry"))


def query_expand(spark, d):
    return search.queries(_requests(spark, d), "words", "area", pages=3).select("id", "ord", "keyword", "page", "query")


def query_together(spark, d):
    return search.queries(_requests(spark, d), "words", "area", suffixes=["contact", ""], pages=2, together=True).select("id", "ord", "query")


def query_excluded(spark, d):
    return _requests(spark, d).select("id", search.excluded_query(F.col("industry"), F.col("area"), ["求人", "口コミ"]).alias("query"))


def area_parts(spark, d):
    c = _companies(spark, d).where(~missing(F.col("area")) & ~missing(F.col("industry")))
    parts = c.select("area", F.col("industry").alias("part")).distinct().withColumn("ord", F.dense_rank().over(W.partitionBy("area").orderBy("part")).cast("bigint"))
    return search.expanded_areas(_requests(spark, d).select("id", "area"), "area", parts).select("id", "area", "part", "ord")


def organic_results(spark, d):
    return search.organic(table(spark, d, "documents"), "url", [*lists.SKIPPED_DOMAINS, "machi-navi.example"]).select("doc_id", "host")


def organic_workflow(spark, d):
    return search.organic(table(spark, d, "documents"), "url", [*lists.WORKFLOW_SKIPPED, "machi-navi.example"]).select("doc_id", "host")


def not_aggregated(spark, d):
    return search.not_aggregated(table(spark, d, "companies"), "hp_url").select("id", "host")


def result_names(spark, d):
    return table(spark, d, "documents").select("doc_id", search.company_name(F.col("title")).alias("name"), search.clean_title(F.col("title")).alias("clean"))


def area_density(spark, d):
    tier = search.density(F.coalesce("area", F.lit("")), HIGH, MIDDLE)
    return _companies(spark, d).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.max(search.most_keywords(tier)).cast("bigint").alias("most"))


# duplicates


def first_forms(spark, d):
    return dedup.first_wins(_companies(spark, d), ["normalized_form_url"], ["id"]).select("id")


def unknown_forms(spark, d):
    return dedup.without_known(table(spark, d, "company_batches"), _companies(spark, d), "normalized_form_url").select("id")


def known_homes(spark, d):
    m = dedup.marked_known(table(spark, d, "company_batches"), _companies(spark, d), "normalized_hp_url", "known")
    return m.select("id", "known")


def merged_sources(spark, d):
    a = _companies(spark, d).select("id", urls.host_key(F.col("hp_url")).alias("host"))
    b = table(spark, d, "company_batches").select("id", urls.host_key(F.col("hp_url")).alias("host"))
    return dedup.merged_sources([a, b], "host", "id").select("id", "host", F.col("source_rank").cast("bigint").alias("source_rank"))


def places_once(spark, d):
    c = _companies(spark, d).select("id", F.coalesce("phone", F.lit("")).alias("place"), urls.host_key(F.col("hp_url")).alias("host"))
    return dedup.places(c, "place", "host", "id").select("id")


def batch_report(spark, d):
    b = table(spark, d, "company_batches").select("ord", urls.host_key(F.col("hp_url")).alias("host"))
    return dedup.batch_report(b, "host", "ord", _companies(spark, d).select(urls.host_key(F.col("hp_url")).alias("host")))


def last_sheet_rows(spark, d):
    return dedup.last_wins(table(spark, d, "sheet_row").where("id IS NOT NULL"), ["id"], ["row_no"]).select("id", "row_no")


def keys_once(spark, d):
    c = _companies(spark, d).select("id", F.coalesce("hp_url", F.lit("")).alias("u"))
    return dedup.computed_once(c, "u", lambda k: k.withColumn("host", urls.host_key(F.col("u")))).select("id", "host")


def _upsert_inputs(spark, d):
    cut = lambda df: df.withColumnsRenamed({"normalized_form_url": "form_key", "normalized_hp_url": "home_key"}).withColumn("form_url", F.coalesce("form_url", F.lit("")))
    return cut(_companies(spark, d)), cut(table(spark, d, "company_batches"))


def upsert_plan(spark, d):
    return dedup.upsert_plan(*_upsert_inputs(spark, d)).select("id", "decision", F.coalesce("target_id", F.lit("")).alias("target_id"))


def upsert_counts(spark, d):
    return dedup.upsert_counts(dedup.upsert_plan(*_upsert_inputs(spark, d)))


def upserted_types(spark, d):
    stored, batch = _upsert_inputs(spark, d)
    out = dedup.upserted(stored, batch, dedup.upsert_plan(stored, batch))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("form_url") != "").alias("forms"), F.count_if(~missing(F.col("phone"))).alias("phones"), F.count_if(~missing(F.col("address"))).alias("addresses"))


# texts and pages


def document_contacts(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", contact.email(t).alias("email"), contact.phone(t).alias("phone"), contact.postal_address(t).alias("address"))


def page_texts(spark, d):
    h = _html()
    return spread(_companies(spark, d), "id").select("id", html.title(h).alias("title"), html.visible_text(h).alias("text"), html.headings(h).alias("headings"), html.short_text(h, 80).alias("short"))


def page_contacts(spark, d):
    h = F.col("html")
    facts = pages.structured_facts(spread(_companies(spark, d), "id").select("id", _html().alias("html")), "id").select("*", contact.first_email(h).alias("first_email"), contact.first_phone(h).alias("first_phone"), F.size(contact.fax_numbers(h)).cast("bigint").alias("faxes"))
    return pages.contacts(facts, "id", "first_email", "first_phone", "faxes")


def _structured_html() -> Column:
    """A company's page with JSON-LD, microdata or both, whose values differ from those in its text."""
    x = lambda n: F.coalesce(F.col(n), F.lit(""))
    place = F.struct(x("area").alias("addressRegion"), x("address").alias("streetAddress"))
    ld = F.struct(F.concat(F.lit("ld."), x("email")).alias("email"), x("phone").alias("telephone"), place.alias("address"))
    json = F.concat(F.lit("<script type=\"application/ld+json\">"), F.to_json(ld), F.lit("</script>"))
    items = F.concat(
        F.lit("<p itemprop=\"telephone\">"), x("phone"), F.lit("</p><div itemprop=\"address\" itemscope><b itemprop=\"addressRegion\">"), x("area"),
        F.lit("</b><b itemprop=\"streetAddress\">"), x("address"), F.lit("</b></div>"),
    )
    kind = F.ascii(F.substring("id", -1, 1)) % 3
    return F.concat(_html(), F.when(kind == 0, json).when(kind == 1, items).otherwise(F.concat(json, items)))


def structured_contacts(spark, d):
    return pages.contacts(pages.structured_facts(spread(_companies(spark, d), "id").select("id", _structured_html().alias("html")), "id"), "id")


def _facts(spark, d, keep_html=True):
    return pages.page_facts(spread(_companies(spark, d), "id").select("id", F.coalesce("hp_url", F.lit("")).alias("url"), _html().alias("html")), "id", keep_html=keep_html)


def page_links(spark, d):
    return pages.link_rows(_facts(spark, d, False), "id").select("id", "pos", "url", "text", "in_footer", "in_nav", "host")


def best_links(spark, d):
    return pages.best_links(pages.scored_links(pages.link_rows(_facts(spark, d, False), "id")), "id")


def page_forms(spark, d):
    facts = _facts(spark, d)
    best = pages.best_links(pages.scored_links(pages.link_rows(facts, "id")), "id")
    return pages.form_url(facts, best, "id")


def page_checks(spark, d):
    facts = _facts(spark, d)
    return facts.select("id", pages.is_form_page(F.col("html"), F.col("forms")).alias("form_page"), pages.refused_without_form(F.col("html")).alias("refused"), pages.has_inline_form(F.col("html")).alias("inline"))


def type_hints(spark, d):
    return _companies(spark, d).select("id", pages.type_hint(F.col("form_url"), _html()).alias("hint"))


def probe_plans(spark, d):
    sites = table(spark, d, "projects").select("id", F.when(F.col("sheets_id").isNull(), "wix").otherwise("").alias("builder"), F.array(F.lit("/contact")).alias("tried"))
    return pages.probe_plan(sites, "id", "builder", "tried")


# classes


def word_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.by_words(F.col("text")).alias("label"))


def page_classes(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", classify.by_page(t, F.coalesce("title", F.lit(""))).alias("label"))


def reclassified(spark, d):
    c = _companies(spark, d).withColumn("form_url", F.when(F.col("area") == "東京都", F.replace("form_url", F.lit("form-box.example"), F.lit("airrsv.net"))).otherwise(F.col("form_url")))
    return classify.reclassified(c).select("id", F.coalesce("new_type", F.lit("")).alias("new_type"))


def stored_types(spark, d):
    c = _companies(spark, d)
    return c.groupBy(dedup.resolved_type(urls.is_line(F.col("form_url")), F.when(F.col("form_type") == "reservation", "booking").otherwise(F.col("form_type"))).alias("form_type")).agg(F.count("*").alias("n"))


def model_identity(spark, d):
    return classify.by_model(_companies(spark, d), "notes", "form_type").select("id", F.coalesce("type", F.lit("")).alias("type"))


# events


def _events(spark, d):
    return table(spark, d, "events")


def event_windows(spark, d):
    return limits.tumbling(_events(spark, d), "ts", "1 day", "event_type")


def event_sessions(spark, d):
    return limits.sessions(_events(spark, d), "user_id", "ts", 7200)


def events_in_window(spark, d):
    return limits.window_count(_events(spark, d), "user_id", "ts", 86400).select("event_id", "in_window")


def events_limited(spark, d):
    return limits.limited(_events(spark, d), "user_id", "ts", "event_id", 2, 86400)


def longest_runs(spark, d):
    e = _events(spark, d).withColumn("turn", F.struct("ts", "event_id"))
    return limits.longest_runs(e, "user_id", "turn", F.col("event_type") != "click")


def latest_values(spark, d):
    e = _events(spark, d).withColumn("big", F.when(F.col("value") > 50, F.col("event_id")))
    return runs.latest_values(e, "user_id", "event_id", ["event_type", "big"])


def event_props(spark, d):
    return _events(spark, d).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# reports


def newest_projects(spark, d):
    return reports.newest(table(spark, d, "projects"), most=20).select("id", "created_at")


def oldest_unsent(spark, d):
    return reports.oldest(_companies(spark, d), F.col("status") == "未送信", "collected_at", 25).select("id", "collected_at")


def run_lookup(spark, d):
    return reports.lookup(_runs(spark, d), "project_id", _first_ids(_runs(spark, d), "project_id", 1)[0], "created_at").select("id", "project_id")


def runs_of_project(spark, d):
    return reports.of_parent(_runs(spark, d), "project_id", _first_ids(_runs(spark, d), "project_id", 2)[1]).select("id", "created_at")


def queue_idle(spark, d):
    return reports.idle(_runs(spark, d), ["running", "pending"])


def sheet_hosts(spark, d):
    return reports.host_set(table(spark, d, "sheet_row"), "HP URL")


def full_pages(spark, d):
    """Runs of a project as pages of a search: read until one is short."""
    rows = _runs(spark, d).select("project_id", "id", F.coalesce("raw_search_count", F.lit(0)).alias("size"))
    return reports.until_short_page(rows, "project_id", "id", "size", 600)


def enough_runs(spark, d):
    rows = _runs(spark, d).select("project_id", "id", F.coalesce("items_written", F.lit(0)).alias("items"))
    return reports.until_enough(rows, "project_id", "id", "items", 2000)


def known_areas(spark, d):
    typed = table(spark, d, "sheet_row").select("row_no", F.col("エリア").alias("area"))
    return reports.known_areas(typed, "area", catalog.facet(_companies(spark, d), "area")).select("row_no", "valid")


def run_payloads(spark, d):
    p = reports.payloads(_companies(spark, d), "run_id", "id", ["name"], size=100)
    return p.select("run_id", "part", "n", F.md5(F.array_join(F.transform("items", lambda i: F.concat(i["id"], F.lit("="), F.coalesce(i["name"], F.lit("")))), ",")).alias("digest"))


def sending_gates(spark, d):
    c = F.coalesce("form_url", F.lit(""))
    return reports.split_by(_companies(spark, d), {"no form": c == "", "reservation": F.col("form_type") == "reservation", "sent": F.col("status") == "送信済み"}).groupBy("gate").agg(F.count("*").alias("n"))


def history_search(spark, d):
    return reports.filtered_history(runs.history(_runs(spark, d), table(spark, d, "projects")), "success", "東京都").select("id", "label")


def recovered_jobs(spark, d):
    r = _runs(spark, d)
    jobs = r.select(F.concat(F.lit("job-"), "id").alias("id"), F.col("id").alias("run_id"), F.when(F.col("run_type") == "single", "active").otherwise("waiting").alias("status"))
    return reports.recovered(jobs, r, "run_id")


def run_metrics(spark, d):
    c = _companies(spark, d)
    return reports.batch_metrics(c, missing(F.col("hp_url")), ~missing(F.col("form_url")), F.when(F.col("form_type") == "reservation", "booking").otherwise(F.col("form_type")))


def outcome_counts(spark, d):
    state = F.when(missing(F.col("form_url")), "no_form").when(F.col("form_type") == "reservation", "skipped_booking").otherwise("written")
    return reports.outcomes(_companies(spark, d), state)


def target_count(spark, d):
    t = F.col("search_target")
    return reports.targets(_runs(spark, d).select(t["keywords"].alias("w"), t["areas"].alias("a")), "w", "a")


def run_speed(spark, d):
    r = _runs(spark, d)
    return reports.per_minute(r, "items_written", F.col("created_at").try_cast("timestamp"), F.col("completed_at").try_cast("timestamp")).select("id", F.coalesce("per_minute", F.lit(-1)).cast("bigint").alias("per_minute"))


def top_form_hosts(spark, d):
    return reports.by_host(_companies(spark, d), "form_url", 15)


def type_shares(spark, d):
    return reports.shares(_companies(spark, d), "industry", "form_type", ["inquiry", "LINE", "reservation", "unknown", ""])


def area_coverage(spark, d):
    estimates = _companies(spark, d).groupBy("area").agg((F.count("*") * 2 + 1).alias("estimate"))
    return reports.coverage(_companies(spark, d).where("form_url <> ''"), "area", estimates)


def label_suggestions(spark, d):
    return reports.suggestions(_runs(spark, d), "label", "歯科")


def project_run_ids(spark, d):
    return reports.all_ids(table(spark, d, "projects"), "run_ids")


def edited_ids(spark, d):
    p = table(spark, d, "projects")
    ids = reports.removed_id(reports.appended_id(F.col("run_ids"), F.lit("run-new")), F.element_at("run_ids", 1))
    return p.select("id", F.array_join(ids, ",").alias("ids"))


def capped_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(reports.capped(F.col("text"), 80), F.lit("")).alias("head"))


QUERIES = [
    url_keys, url_flags, stored_keys_agree, host_counts, host_top, grid_page, grid_search, grid_counts, grid_in_runs, facet_industry, facet_area, status_counts, type_counts,
    type_by_industry, project_stats, form_keys, home_keys, localised_rows, imported_rows, bulk_update, run_deleted, pruned, collected_at, csv_lines, tab_counts, run_history,
    run_tree, run_children, batch_rollup, rollup_needed, conversion, success_share, queue_position, newest_runs, stale_runs, next_project, token_totals, actual_counts,
    child_targets, retries, file_names, query_expand, query_together, query_excluded, area_parts, organic_results, organic_workflow, not_aggregated, result_names, area_density, first_forms,
    unknown_forms, known_homes, merged_sources, places_once, batch_report, last_sheet_rows, keys_once, upsert_plan, upsert_counts, upserted_types, document_contacts, page_texts,
    page_contacts, structured_contacts, page_links, best_links, page_forms, page_checks, type_hints, probe_plans, word_classes, page_classes, reclassified, stored_types, model_identity,
    event_windows, event_sessions, events_in_window, events_limited, longest_runs, latest_values, event_props,
    newest_projects, oldest_unsent, run_lookup, runs_of_project, queue_idle, sheet_hosts, full_pages, enough_runs, known_areas, run_payloads, sending_gates, history_search,
    recovered_jobs, run_metrics, outcome_counts, target_count, run_speed, top_form_hosts, type_shares, area_coverage, label_suggestions, project_run_ids, edited_ids, capped_texts,
]
