"""Queries over made-up web sites, one for each company: links, forms, checks, probes, and what pages say of themselves.

Each company has one of a dozen kinds of site, by the last letter of its id. What must come out is known by construction
and stands in `sites_sql`. {h} stands for the site's own address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.operators import pages
from leadloom.sources import readers
from leadloom.sources.tables import spread, table

_LONG = "<p>" + "当院は地域の皆さまに寄り添う施設です。" * 20 + "</p>"
_FORM = '<form method="post"><input type="text" name="name"><input type="email" name="mail"><textarea name="body"></textarea><input type="submit"></form>'
FORM_PAGE = f"<html><head><title>フォーム</title></head><body>{_LONG}{_LONG}{_FORM}</body></html>"


def _page(body: str, head: str = "") -> str:
    return f"<html><head><title>トップ</title>{head}</head><body>{_LONG}{body}</body></html>"


#: The home pages by kind.
HOMES = [
    _page('<p>x</p><footer><a href="/contact/">お問い合わせ</a></footer>'),
    _page('<nav><a href="inquiry.html?utm_source=x">Contact us</a></nav>', '<base href="/ja/">'),
    _page('<button onclick="location.href=\'/toiawase/\'">お問い合わせ</button><a href="#" data-href="https://form.run/@x" title="資料請求">フォーム</a>'),
    _page(f'<a href="/recruit/entry">採用エントリー</a>{_FORM}'),
    _page("<p>予約はこちら</p>"),
    _page('<a href="https://lin.ee/abc">LINEでお問い合わせ</a>'),
    _page('<a href="/blog/">ブログ</a>', '<meta property="og:type" content="Website">'),
    _page("<p>ご案内</p>", '<meta http-equiv="refresh" content="3; url=/top.html">'),
    _page('<a href="/contact/">お問い合わせ</a><a href="/mailform/">メール送信</a>', '<link rel="stylesheet" href="/wp-content/a.css">'),
    _page('<a href="https://x.com/a">お問い合わせ</a><a href="/yoyaku">ご予約</a>'),
    '<html><head><title>App</title></head><body><div id="__next"></div><a href="/contact"><img alt="お問い合わせ"></a></body></html>',
    _page('<script src="https://form.run/embed.js"></script>', '<link rel="canonical" href="/index/">'),
]
#: Fetched pages by kind: path, final path (None: not moved), status, HTML.
FETCHED = [
    (0, "/contact/", None, 200, FORM_PAGE),
    (1, "/ja/inquiry.html?utm_source=x", None, 200, FORM_PAGE),
    (2, "/toiawase/", "/", 200, HOMES[2]),
    (6, "/contact", None, 404, "<p>404</p>"),
    (6, "/otoiawase", "/otoiawase/?utm_source=a", 200, FORM_PAGE),
    (6, "/inquiry", None, 200, "<title>ページが見つかりません</title>" + _LONG * 3),
    (8, "/contact/", None, 404, FORM_PAGE),
    (8, "/mailform/", None, 200, FORM_PAGE),
    (10, "/contact", None, 200, "<html><body><div>" + "読み込み中です。" * 5 + "</div></body></html>"),
]


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """(id, kind, url): the companies with their kind of site; one kind is a booking service's own page."""
    kind = F.ascii(F.substring("id", -1, 1)) % len(HOMES)
    own = F.concat(F.lit("https://www."), F.replace("id", F.lit("_"), F.lit("-")), F.lit(".example/"))
    return spread(table(spark, d, "companies"), "id").select("id", kind.alias("kind"), F.when(kind == 7, F.concat(F.lit("https://coubic.com/"), "id")).otherwise(own).alias("url"))


def _homes(spark: SparkSession, d: str) -> DataFrame:
    html = F.element_at(F.array(*map(F.lit, HOMES)), F.col("kind") + 1)
    moved = F.when(F.col("kind") == 4, F.lit("https://beauty.hotpepper.jp/sln/x/"))
    return _kinds(spark, d).select("id", "kind", "url", moved.alias("final_url"), html.alias("html"))


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    # a fixed table of a few rows
    given = spark.createDataFrame(FETCHED, "kind int, path string, moved string, status_code int, html string")
    at = lambda c: F.concat(F.substring("url", 1, F.length("url") - 1), c)
    rows = _kinds(spark, d).join(F.broadcast(given), "kind")
    return rows.select(at(F.col("path")).alias("url"), at(F.coalesce("moved", "path")).alias("final_url"), "status_code", "html")


def _home_facts(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_facts(_homes(spark, d), "id")


def site_links(spark, d):
    return pages.link_rows(_home_facts(spark, d), "id").select("id", "pos", "kind", "url", "text", "in_footer", "in_nav", "host")


def site_best_links(spark, d):
    return pages.best_links(pages.scored_links(pages.link_rows(_home_facts(spark, d), "id")), "id")


def site_forms(spark, d):
    facts = _home_facts(spark, d)
    out = pages.form_url(facts, pages.best_links(pages.scored_links(pages.link_rows(facts, "id")), "id"), "id")
    return out.select("id", F.coalesce("form_url", F.lit("")).alias("form_url"), F.coalesce("source", F.lit("")).alias("source"))


def site_found_forms(spark, d):
    return pages.found_forms(_homes(spark, d).drop("kind"), _fetched(spark, d), "id")


def site_targets(spark, d):
    """Every fetched page as a target of the site it belongs to."""
    got = _fetched(spark, d)
    pages_ = pages.page_facts(got.withColumn("page", F.col("url")), "page").select("url", "html", "forms").join(got.select("url", "final_url", "status_code"), "url")
    root = F.regexp_extract("url", "^(https://[^/]+/)", 1)
    targets = pages_.select(F.col("url").alias("id"), F.lit(1).alias("rank"), "url", root.alias("base_url"), F.col("url").rlike("/contact$").alias("is_shell"))
    return pages.verified_targets(targets, pages_, "id").select("id", "final_url", "valid")


def site_probes(spark, d):
    """Every fetched page as a probe of its site: why it is no page of its own."""
    home = _homes(spark, d).select("url", F.col("html").alias("home"), "kind")
    got = _fetched(spark, d).withColumn("root", F.regexp_extract("url", "^(https://[^/]+/)", 1)).join(home.withColumnRenamed("url", "root"), "root")
    c = F.col
    why = pages.soft_404({"url": c("root"), "html": c("home")}, {"url": c("final_url"), "asked": c("url"), "html": c("html"), "status_code": c("status_code")}, c("kind") == 10)
    return got.select("url", why.alias("why"))


def site_marks(spark, d):
    """What the home pages say of themselves."""
    h = F.col("html")
    return _homes(spark, d).select(
        "id", H.builder(h).alias("builder"), H.rendered_by_script(h).alias("shell"), H.refresh_target(h).alias("refresh"), H.og_type(h).alias("og_type"), H.base_href(h).alias("base"), H.canonical_href(h).alias("canonical"),
    )


def site_checks(spark, d):
    facts = _home_facts(spark, d)
    return facts.select("id", pages.is_form_page(F.col("html"), F.col("forms")).alias("form_page"), pages.has_inline_form(F.col("html")).alias("inline"), "base")


#: Pages with one form each, and whether it is one for inquiries: the golden cases of form checks.
FORM_CASES = [
    _FORM,
    '<form><input type="text">カート<input type="email"><textarea></textarea><input type="submit"></form>',
    '<form><input type="text">お問い合わせ内容 カート<textarea></textarea></form>',
    '<form><input type="password"><textarea>お問い合わせ</textarea></form>',
    '<form class="comment-form"><input type="text" name="name"><input type="email"><textarea></textarea></form>',
    '<form>お問い合わせ<input type="tel"><input type="submit"></form>',
    '<form><input type="text"><textarea></textarea>ご予約日時</form>',
    '<form id="search"><input type="search"></form>' + _FORM,
]


def form_checks(spark, d):
    html = F.element_at(F.array(*map(F.lit, FORM_CASES)), F.ascii(F.substring("id", -1, 1)) % len(FORM_CASES) + 1)
    facts = pages.page_facts(table(spark, d, "companies").select("id", F.lit("https://a.example/").alias("url"), html.alias("html")), "id")
    return facts.select("id", pages.is_form_page(F.col("html"), F.col("forms")).alias("form_page"))


def refused_pages(spark, d):
    """Documents as pages without a form: their title decides."""
    page = F.concat(F.lit("<title>"), F.coalesce("title", F.lit("")), F.lit("</title>"))
    return table(spark, d, "documents").select("doc_id", pages.refused_without_form(page).alias("refused"))


def simple_scores(spark, d):
    score = pages.simple_link_score(F.coalesce("name", F.lit("")), F.coalesce("form_url", F.lit("")), ["contact", "inquiry", "hair", "美容"])
    return table(spark, d, "companies").select("id", score.cast("bigint").alias("score"))


def form_element_pages(spark, d):
    """Documents that hold one of some marks."""
    marks = {"phone": r"\d{2,4}-\d{2,4}-\d{4}", "yen": "円", "mail": "(?i)mail"}
    return table(spark, d, "documents").select("doc_id", pages.form_elements(F.col("text"), marks).alias("hit"))


def booking_fallbacks(spark, d):
    """Companies whose form is taken away: those at a booking service keep its address."""
    home = F.when(F.ascii(F.substring("id", -1, 1)) % 3 == 0, F.concat(F.lit("https://www.coubic.com/"), "id")).otherwise(F.col("hp_url"))
    rows = table(spark, d, "companies").select("id", home.alias("hp_url"), F.when(F.col("area") == "東京都", F.col("form_url")).alias("form_url"))
    return pages.booking_fallback(rows, "hp_url", "form_url").select("id", "form_url", "by_booking")


def length_ratios(spark, d):
    """Documents against the one before: whether their lengths differ by less than 3 %."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = t.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old"))
    return t.join(before, "doc_id").select("doc_id", pages.near_length(F.col("old"), F.col("text")).alias("near"))


def followed_pages(spark, d):
    """Where addresses lead by redirects: runs lead to their parent runs, these to their project."""
    at = lambda c: F.concat(F.lit("https://r.example/"), c)
    runs = table(spark, d, "project_runs")
    hops = runs.select(at(F.col("id")).alias("url"), at(F.coalesce("parent_run_id", "project_id")).alias("location"))
    ends = table(spark, d, "projects").select(at(F.col("id")).alias("url"), F.lit(None).cast("string").alias("location"))
    return readers.followed(hops.unionAll(ends).dropDuplicates(["url"])).select("url", "final_url", "hops")


def page_bytes(spark, d):
    """Texts as bytes, some marked by a header, some by the document, some not at all, read again; bytes beyond a limit are left out."""
    text = F.coalesce("text", F.lit(""))
    head = F.when(F.col("doc_id") % 3 == 0, "text/html; charset=utf-8")
    raw = F.encode(F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit('<meta charset="UTF-8">'), text)).otherwise(text), "UTF-8")
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw"), head.alias("content_type"))
    return readers.decoded_pages(rows, "doc_id", most_bytes=200_000).select("doc_id", F.md5("html").alias("digest"))


QUERIES = [
    site_links, site_best_links, site_forms, site_found_forms, site_targets, site_probes, site_marks, site_checks, form_checks, refused_pages, simple_scores, form_element_pages,
    booking_fallbacks, length_ratios, followed_pages, page_bytes,
]
