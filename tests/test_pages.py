from pyspark.sql import functions as F

from leadloom.operators import pages

HOME = "https://www.shop.example/"
NAV = '<nav><a href="/contact/">お問い合わせ</a></nav>'
PAGES = [
    (1, NAV + '<footer><a href="http://shop.example/contact">Contact us</a></footer>'),
    (2, '<a href="/blog/">blog</a><a href="https://x.com/a">お問い合わせ</a><a href="/yoyaku">ご予約</a>'),
    (3, '<a href="https://forms.gle/abc">フォーム</a><a href="#x" data-href="/inquiry.php?utm_source=a">x</a>'),
    (4, '<button onclick="location.href=\'/toiawase\'">go</button><iframe src="https://tayori.com/f/x">'),
    (5, '<form action="x"><textarea></textarea></form>'),
    (6, '<iframe src="https://form.run/@x"></iframe>'),
    (7, None),
    (8, "<p>" + "長い" * 300_000),
    (9, '<script type="application/ld+json">[{"email":"a@b.example","contactPoint":{"telephone":"03-1"},"address":{"postalCode":"100-0001","addressRegion":"東京都"}}]</script><script type="application/ld+json">{bad</script>'),
]


def facts(spark):
    return pages.page_facts(spark.createDataFrame([(i, HOME, h, "clash") for i, h in PAGES], "id int, url string, html string, links string"), "id")


def test_links_scores_and_best(spark):
    f = facts(spark).cache()
    best = pages.best_links(pages.scored_links(pages.link_rows(f, "id")), "id")
    got = {(r["id"], r["rank"]): (r["url"], r["score"]) for r in best.collect()}
    assert got[1, 1] == ("https://www.shop.example/contact/", 22)  # word 12, path 8, nav 2
    assert (1, 2) not in got  # the same page without www. and slash
    assert not [k for k in got if k[0] == 2]
    assert got[3, 1] == ("https://www.shop.example/inquiry.php?utm_source=a", 18) and got[3, 2] == ("https://forms.gle/abc", 15)
    assert got[4, 1] == ("https://www.shop.example/toiawase", 10)
    forms = {r["id"]: (r["form_url"], r["source"]) for r in pages.form_url(f, best, "id").collect()}
    assert forms[5] == (HOME, "inline") and forms[6] == ("https://form.run/@x", "iframe") and forms[7] == (None, None) and forms[1][1] == "link"
    ld = f.where("id = 9").first()
    assert (ld["ld_email"], ld["ld_phone"], ld["ld_address"]) == ("a@b.example", "03-1", "〒100-0001 東京都")


INQUIRY = '<form><input type="text" name="name"><input type="email"><textarea></textarea><button>送信</button></form>'
CHECKS = [
    (INQUIRY, True),
    ("<title>お問い合わせ | 店</title><form></form>", True),
    ("<title>店</title>no form", False),
    ('<form><input type="password"><textarea>お問い合わせ</textarea></form>', False),
    ('<form><input type="text" name="q"></form>', False),
    ('<form><input type="text">カート<input type="email"><textarea></textarea><input type="submit"></form>', False),
    ('<form><input type="text">お問い合わせ内容 カート<textarea></textarea></form>', True),
    ('<form class="comment-form"><input type="text" name="name"><input type="email"><textarea></textarea></form>', False),
    ('<form>newsletter<input type="email"><input type="submit"></form>', False),
    ('<form>お問い合わせ<input type="tel"><input type="submit"></form>', True),
    ('<form><input type="text"><textarea></textarea>ご予約日時</form>', False),
    ('<form id="search"><input type="search"></form>' + INQUIRY, True),
    ('<a href="https://docs.google.com/forms/d/x">', True),
    ('{"@type": "ContactPage"}', True),
    (None, False),
]


def test_form_pages(spark):
    rows = [(i, HOME, h) for i, (h, _) in enumerate(CHECKS)]
    f = pages.page_facts(spark.createDataFrame(rows, "id int, url string, html string"), "id")
    got = {r["id"]: r["ok"] for r in f.select("id", pages.is_form_page(F.col("html"), F.col("forms")).alias("ok")).collect()}
    assert {i: (CHECKS[i][0], got[i]) for i in got} == {i: c for i, c in enumerate(CHECKS)}


def test_targets(spark):
    targets = spark.createDataFrame(
        [(1, 1, "https://a.example/x", "https://a.example/", False), (1, 2, "https://a.example/y", "https://a.example/", False), (2, 1, "https://form.run/x", "https://b.example/", False),
         (3, 1, "https://c.example/contact", "https://c.example/", True), (4, 1, "https://d.example/c", "https://d.example/", False)],
        "id int, rank int, url string, base_url string, is_shell boolean",
    )
    fetched = spark.createDataFrame(
        [("https://a.example/x", "https://a.example", 200, INQUIRY), ("https://a.example/y", "https://a.example/y?utm_source=1", 200, INQUIRY),
         ("https://c.example/contact", None, 200, "<div>" + "x" * 50), ("https://d.example/c", None, 404, INQUIRY)],
        "url string, final_url string, status_code int, html string",
    ).withColumn("forms", F.array("html"))
    out = pages.verified_targets(targets, fetched, "id")
    assert {(r["id"], r["rank"]): r["valid"] for r in out.collect()} == {(1, 1): False, (1, 2): True, (2, 1): True, (3, 1): True, (4, 1): False}
    assert {r["id"]: r["form_url"] for r in pages.first_valid(out, "id").collect()} == {1: "https://a.example/y", 2: "https://form.run/x", 3: "https://c.example/contact"}


def test_soft_404(spark):
    home = "<title>店</title>" + "ようこそ" * 200
    cases = [("/a", 200, "<title>店</title>" + "あ" * 900, "title"), ("/b", 404, "x", "error"), ("/c", 503, "x", "neutral"), ("/", 200, "y" * 900, "home"), ("/d", 200, "短い", "short"),
             ("/e", 200, "<b>店</b>" + "ようこそ" * 198 + "。。" + "い" * 500, "same"), ("/f", 200, "<title>別</title>" + "お問い合わせ" * 200, "")]
    df = spark.createDataFrame([(HOME, home, "https://www.shop.example" + p, s, h) for p, s, h, _ in cases], "hu string, hh string, u string, s int, h string")
    c = F.col
    got = df.select(pages.soft_404({"url": c("hu"), "html": c("hh")}, {"url": c("u"), "asked": c("u"), "html": c("h"), "status_code": c("s")}, F.lit(False))).collect()
    assert [r[0] for r in got] == [w for *_, w in cases]


def test_abort_after_bad_ones_in_a_row(spark):
    bad = "bbgbbbbbgg"
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(bad)], "site int, o int, x string")
    kept = pages.before_abort(df, "site", "o", F.col("x") == "b", 5)
    assert sorted(r["o"] for r in kept.collect()) == list(range(8))


def test_probe_plan(spark):
    sites = spark.createDataFrame([(1, "", ["/contact"]), (2, "shopify", []), (3, "jimdo", [])], "id int, b string, tried array<string>")
    rows = pages.probe_plan(sites, "id", "b", "tried").orderBy("id", "ord").collect()
    by = {i: [r["path"] for r in rows if r["id"] == i] for i in (1, 2, 3)}
    assert len(by[1]) == 28 and "/contact" not in by[1] and "/contact/" not in by[1] and by[1][0] == "/inquiry"
    assert by[2][0] == "/pages/contact" and not [p for p in by[2] + by[3] if ".php" in p] and not [p for p in by[3] if p.startswith("/pages/")]


def test_booking_and_simple_scores(spark):
    df = spark.createDataFrame([("https://x.coubic.com/", None), ("https://a.example/", "")], "u string, f string")
    assert [r["f"] for r in pages.booking_fallback(df, "u", "f").collect()] == ["https://x.coubic.com/", ""]
    s = spark.createDataFrame([("Contact", "https://a.example/contact")], "t string, u string").select(pages.simple_link_score(F.col("t"), F.col("u"), ["contact", "問い合わせ"])).first()[0]
    assert s == 23


def test_home_pages_redirected_to_a_booking_service(spark):
    rows = [(1, "https://a.example/", "https://www.coubic.com/a"), (2, "https://b.example/", "https://b.example/top"), (3, "https://coubic.com/c", "https://coubic.com/c"), (4, "https://d.example/", None), (5, "https://e.example/", "https://notcoubic.com/"), (6, None, "https://x.reserva.be/")]
    out = pages.booking_redirect(spark.createDataFrame(rows, "id int, url string, final_url string"), "id")
    assert sorted(map(tuple, out.collect())) == [(1, "https://www.coubic.com/a", "booking"), (6, "https://x.reserva.be/", "booking")]
