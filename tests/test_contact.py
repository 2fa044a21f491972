import pytest
from pyspark.sql import functions as F

from leadloom.functions import contact, html
from leadloom.operators import pages

CASES = [
    (contact.phone, '<a href="tel:03-1234-5678">', "03-1234-5678"),
    (contact.phone, "FAX 03-1111-2222 TEL：03-1234-5678", "03-1234-5678"),
    (contact.phone, "電話：０３（１２３４）５６７８", "03(1234)5678"),
    (contact.phone, "0312345678", "0312345678"),
    (contact.phone, "+81-3-1234-5678", "+81-3-1234-5678"),
    (contact.phone, "03-123-456", ""),
    (contact.phone, "fax: 03-1234-5678", ""),
    (contact.phone, None, ""),
    (contact.first_phone, "call 03 1234 5678", "0312345678"),
    (contact.email, '<a href="mailto:taro@a.example"> <a href="mailto:info@a.example">', "info@a.example"),
    (contact.email, "logo@2x.png taro@a.co.jp", "taro@a.co.jp"),
    (contact.email, "info[at]a.co.jp", "info@a.co.jp"),
    (contact.email, "", ""),
    (contact.first_email, "no-reply@a.jp", ""),
    (contact.postal_address, "〒100－0001　本社は東京都千代田区1-1<br>次</p>", "〒100-0001 本社は東京都千代田区1-1 次"),
    (contact.postal_address, "住所：本社ビルは大阪城北の大阪府大阪市1-1</p>", "本社ビルは大阪城北の大阪府大阪市1-1"),
    (contact.postal_address, "<td>北海道札幌市中央区北一条西2丁目</td>", "北海道札幌市中央区北一条西2丁目"),
    (contact.postal_address, "no address", ""),
    (html.title, "<TITLE a='b'> A &amp;\n B </TITLE>", "A & B"),
    (html.title, None, ""),
    (html.visible_text, "<style>x</style><label>a</label>&lt;b&gt;<noscript>n</noscript>", "a <b>"),
    (html.headings, "<h1>A<br></h1><h2> </h2><h2>B</h2><h3>C</h3>", "A / B"),
    (html.og_type, '<meta content="Article" property="og:type">', "article"),
    (html.refresh_target, '<meta http-equiv="refresh" content="0; url=/x/">', "/x/"),
    (html.canonical_href, '<link href="https://a.example/c" rel="canonical">', "https://a.example/c"),
    (html.builder, "<script src='//cdn.shopify.com/x'>", "shopify"),
]


@pytest.mark.parametrize("function, text, want", CASES)
def test_case(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0] == want


def test_form_text(spark):
    page = "<h1>お問い合わせ</h1>" + "x" * 3000 + "<form>名前</form>" + "y" * 3000
    out = spark.createDataFrame([(page,)], "t string").select(html.form_text(F.col("t"))).first()[0]
    assert out.startswith("お問い合わせ\n") and "名前" in out and len(out) < 2800


def test_merge_direction(spark):
    df = spark.createDataFrame([("form", "home"), ("", "home"), (None, None)], "f string, h string")
    assert [tuple(r) for r in df.select(contact.merged(F.col("f"), F.col("h")), contact.merged(F.col("f"), F.col("h"), True)).collect()] == [("form", "home"), ("home", "home"), ("", "")]


STRUCTURED = [
    ('<script type="application/ld+json">{"email": "ld@a.jp", "telephone": "03-1111-2222", "address": {"postalCode": "100-0001", "addressRegion": "東京都", "streetAddress": "1-1"}}</script>'
     '<a href="mailto:info@b.jp"><a href="tel:03-3333-4444"><p>住所：大阪府大阪市北区1-1-1</p>', ("ld@a.jp", "03-1111-2222", "〒100-0001 東京都 1-1")),
    ('<script type="application/ld+json">{"telephone": "12"}</script><p itemprop="telephone">03-1111-2222</p> TEL 03-3333-4444', ("", "", "")),
    ('<b itemprop="telephone" class="x"> ０３ </b> TEL 03-3333-4444', ("", "03-3333-4444", "")),
    ('<b itemprop="telephone"> 03（1111）2222 </b> TEL 03-3333-4444', ("", "03(1111)2222", "")),
    ('<b>x</b>03-1111-2222<i itemprop="telephone"></i> TEL 03-3333-4444', ("", "03-1111-2222", "")),
    ('FAX 03-1111-2222 <b itemprop="telephone">03-1111-2222</b>', ("", "03-1111-2222", "")),
    ('<p itemprop="address">大阪府　大阪市 1-1</p><p>住所：東京都千代田区千代田1-1</p>', ("", "", "大阪府 大阪市 1-1")),
    ('<div itemprop="address" itemscope><b itemprop="postalCode">〒100-0001</b><b itemprop="addressRegion">東京都</b></div>', ("", "", "〒100-0001 東京都")),
    ('<b itemprop="addressRegion">東京都</b><p>住所：本社は大阪にある大阪府大阪市1-1</p>', ("", "", "本社は大阪にある大阪府大阪市1-1")),
    (None, ("", "", "")),
]


def test_structured_data_comes_first(spark):
    df = spark.createDataFrame([(i, "https://a.example/", h) for i, (h, _) in enumerate(STRUCTURED)], "id int, url string, html string")
    got = {r["id"]: (r["email"], r["phone"], r["address"]) for r in pages.contacts(pages.page_facts(df, "id"), "id").collect()}
    assert got == {i: want for i, (_, want) in enumerate(STRUCTURED)}


def test_script_shells(spark):
    shells = ["<script>window.__remixContext = {}</script>", "<astro-island uid='1'>", '<app-root ng-version="17">', "<app-root>", "window.angular", """<div id="app" data-page='{"component":"Home"}'>""", '<div id="app"></div>', "__NUXT__"]
    others = ["<app-rooted>", "<div data-page='{}'>", '<div id="app">x</div>', "", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*shells, *others])], "i int, h string")
    assert {r["i"] for r in df.where(html.rendered_by_script(F.col("h"))).collect()} == set(range(len(shells)))
