import pytest
from pyspark.sql import functions as F

from leadloom.functions import urls

CASES = [
    ("store_key", None, ""),
    ("store_key", "", ""),
    ("store_key", "HTTPS://user:pw@WWW.Shop.example:8443//a//b//?UTM_Source=x&b=1&SITE_CODE=2#top", "shop.example/a/b?b=1"),
    ("store_key", "https://a.example/x/?q=1&amp;ref=top", "a.example/x?q=1"),
    ("store_key", "  not an address ", "not an address"),
    ("store_key", "https://a_b.example/お問い合わせ/", "a_b.example/%e3%81%8a%e5%95%8f%e3%81%84%e5%90%88%e3%82%8f%e3%81%9b"),
    ("store_key", "https://a.example/x y?", "a.example/x%20y"),
    ("page_key", "http://A.example/X/?q#f", "http://a.example/X"),
    ("page_key", "x", "x"),
    ("host_key", "https://www.A.example:80/", "a.example"),
    ("host_key", "nothing", ""),
    ("raw_host", "https://www.A.example:80/x", "A.example:80"),
    ("raw_host", "ftp://a.example/", ""),
    ("without_tracking", "https://a.example/?a=1&utm_source=2&b=3#f", "https://a.example/?a=1&b=3#f"),
    ("link_key", "https://www.a.example/c/?ref=1&x=2", "a.example/c?x=2"),
    ("tried_path", "https://a.example/Contact/?x", "/contact"),
    ("display", "https://www.a.example/0123456789/0123456789/", "a.example/0123456789/01234567…"),
    ("display", "mailto:" + "x" * 50, ("mailto:" + "x" * 50)[:35]),
    ("decoded", "%E3%81%94+%E7%9B%B8", "ご+相"),
    ("decoded", "%E3%81", None),
]


@pytest.mark.parametrize("name, url, want", CASES)
def test_case(spark, name, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(getattr(urls, name)(F.col("u"))).first()[0] == want


def test_flags(spark):
    df = spark.createDataFrame([("https://form.a.example/x", "https://www.a.example/"), ("https://lin.ee/x", "https://a.example/"), (None, None)], "u string, b string")
    rows = df.select(urls.is_internal(F.col("u"), F.col("b")), urls.contact_subdomain(F.col("u")), urls.is_line(F.col("u")), urls.on_hosts(urls.host_key(F.col("u")), ["a.example"])).collect()
    assert tuple(rows[0]) == (True, True, False, True)
    assert tuple(rows[1]) == (False, False, True, False)
    assert tuple(rows[2]) == (True, False, False, False)


def test_host_rules(spark):
    df = spark.createDataFrame([("x.hotpepper.jp",), ("nothotpepper.jp",), ("",)], "h string")
    assert [r[0] for r in df.select(urls.on_hosts(F.col("h"), ["hotpepper.jp"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(urls.holds_host(F.col("h"), ["hotpepper.jp"])).collect()] == [True, True, False]
