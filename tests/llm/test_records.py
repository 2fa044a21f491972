import random

import pytest
from pyspark.sql import functions as F

from leadloom.llm import address, canonical, history, names, survivor

# survivors

GROUP = "g string, id string, phone string, email string, form_type string, at string, n string"


def survivors(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], GROUP)
    fields = {"phone": survivor.usable_phone(F.col("phone")), "email": survivor.usable_email(F.col("email")), "form_type": survivor.usable_type(F.col("form_type"))}
    return sorted(map(tuple, survivor.survivors(df, "g", "id", "at", fields).collect()))


def test_survivors(spark):
    rows = [
        ("a", "1", "03-1234-5678", "x@y.jp", "unknown", "2026-01-01T00:00:00Z"),
        ("a", "2", "０９０１２３４５６７８", "noreply@y.jp", None, "2026/1/1 9:00:01"),
        ("a", "3", "0000000000", "bg@main.jpg", "", "2026-05-05T00:00:00Z"),
        ("b", "5", "+81-3-1234-5678", "X@Y.Z", "LINE", None),
        ("b", "4", "+81-3-1234-5678", "no-reply@y.z", "LINE", "?"),
        ("c", "6", "03-1234-5678", "x@y.jp", "LINE", "2026-01-01T00:00:00Z"),
        ("", "7", "03-1234-5678", "x@y.jp", "LINE", None),
        (None, "8", "03-1234-5678", "x@y.jp", "LINE", None),
        ("d", "9", None, "info@", None, None),
        ("d", None, "03-1234-5678", "a@b.c", "LINE", "2026-01-01"),
        ("e", "10", "x" * 100_000, None, None, None),
        ("e", "10", "x" * 100_000, None, None, None),
    ]
    assert survivors(spark, rows) == [("1", "2", "1", ""), ("10", "", "", ""), ("4", "4", "5", "4")]
    assert survivors(spark, []) == []


def test_instants(spark):
    cases = [("2026/4/9 0:54:09", "2026-04-08T15:54:09Z"), ("2026-04-09", "2026-04-08T15:00:00Z"), ("2026-04-09T00:54:09", "2026-04-08T15:54:09+00:00"), ("2026-04-09T00:54:09.5+0900", "2026-04-08T15:54:09.500Z")]
    for a, b in cases:
        r = spark.createDataFrame([(a, b)], "a string, b string").select(survivor.instant(F.col("a")), survivor.instant(F.col("b"))).first()
        assert r[0] == r[1] and r[0] is not None, a


def test_consensus(spark):
    rows = [("a", "3", "秋葉コテフウ美容室"), ("a", "1", "秋葉コテフウ美容室"), ("a", "2", "株式会社秋葉コテフウ美容室"), ("a", "4", None), ("b", "5", ""), ("b", "6", None), ("c", "7", "x"), ("d", "8", "ab cd"), ("d", "9", "ab xx cd"), ("d", "10", "ab cd yy"), ("", "0", "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "g string, id string, name string, w int")
    for parts in (64, 1):
        got = sorted(map(tuple, survivor.consensus(df, "g", "id", "name", parts=parts).collect()))
        assert got == [("1", "1", "秋葉コテフウ美容室"), ("10", "8", "ab cd")]
    assert survivor.consensus(df.where("false"), "g", "id", "name").count() == 0


def test_consensus_by_recency(spark):
    rows = [("a", "1", "03-1111-2222", "2020-01-01"), ("a", "2", "03-1111-2222", "2020-01-01"), ("a", "3", "03-9999-8888", "2026-01-01"), ("b", "4", "x", None), ("b", "5", "y", "2020/1/1 9:00:00"), ("c", "6", "z", "?"), ("c", "7", "z", None)]
    df = spark.createDataFrame(rows, "g string, id string, v string, at string")
    got = sorted(map(tuple, survivor.consensus(df, "g", "id", "v", survivor.recency(F.col("at"))).collect()))
    assert got == [("1", "3", "03-9999-8888"), ("4", "5", "y"), ("6", "6", "z")]
    assert ("1", "1", "03-1111-2222") in set(map(tuple, survivor.consensus(df, "g", "id", "v").collect()))


# formatting copies


def test_copies(spark):
    rows = [
        ("1", "HTTPS://A.example/x/?b=2&a=1", None), ("2", "https://a.example/x?a=1&b=2", ""), ("3", " https://a.example/X?A=1&b=2 ", "　"), ("4", "http://a.example/x?a=1&b=2", ""), ("5", None, ""),
        ("6", "", None), ("2", "https://a.example/x?a=1&b=2", ""), (None, "", ""), ("7", "u" * 200_000, "v"), ("8", "U" * 200_000, "V"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, form_url string, hp_url string, h1 int")
    fields = [canonical.canonical_url(F.col("form_url")), canonical.canonical_url(F.col("hp_url"))]
    assert sorted(map(tuple, canonical.copy_pairs(df, "id", fields).collect())) == [("1", "2"), ("1", "3"), ("2", "3"), ("5", "6"), ("7", "8")]
    assert sorted(r["copies"] for r in canonical.copies(df, "id", fields).collect()) == [1, 2, 3, 4]
    assert canonical.copy_pairs(df.where("false"), "id", fields).count() == 0


# history

SAME_PAGE = [
    "https://www.a.example/contact/?b=1&a=2", "http://a.example/contact?a=2&b=1&utm_id=9", "https:// a.example//contact/index.html?a=2&PHPSESSID=x&b=1#top", "ttps://A.EXAMPLE:443/contact/;jsessionid=A?a=2&amp;b=1",
    "https://a.example/%63ontact/?a=2&b=1?mc_cid=3",
]


def page_of(spark, u):
    return spark.createDataFrame([(u,)], "u string").select(history.page(F.col("u"))).first()[0]


def test_pages(spark):
    assert {page_of(spark, u) for u in SAME_PAGE} == {"a.example/contact?a=2&b=1"}
    assert page_of(spark, "https://a.example/お問い合わせ/") == page_of(spark, "https://a.example/%E3%81%8A%E5%95%8F%E3%81%84%E5%90%88%E3%82%8F%E3%81%9B")
    assert len({page_of(spark, u) for u in ("https://a.example/s/1", "https://a.example/s/2", "https://a.example/s/1?form=2", "https://b.a.example/s/1")}) == 4
    assert page_of(spark, None) == page_of(spark, " ") == page_of(spark, "なし") == ""


def test_escapes_within_escapes(spark):
    """A copy with one character percent-encoded may have hit a digit of an escape: %9%42 for %9B."""
    site, sent = "https://a.example/", "https://a.example/%E3%81%8A%E5%95%8F%E3%81%84%E5%90%88%E3%82%8F%E3%81%9B/"
    for digits in ("%9%42", "%9%62", "%%39B", "%%39%42"):
        assert page_of(spark, sent.replace("%9B", digits)) == page_of(spark, sent) == "a.example/お問い合わせ", digits
    assert page_of(spark, site + "?q=%E3%8%31%82") == page_of(spark, site + "?q=%E3%81%82")
    # well-formed escapes are read once; what is no escape stays, and so do two pages that differ in it
    assert page_of(spark, site + "%25%34%31") == "a.example/%41" and page_of(spark, site + "%2541") == "a.example/%41"
    assert page_of(spark, site + "50%") == "a.example/50%" and page_of(spark, site + "50%%3x") == "a.example/50%%3x"
    schema = "id string, form_url string, hp_url string, ord bigint"
    past = spark.createDataFrame([("c", sent, None, 0)], schema)
    new = spark.createDataFrame([("n", sent.replace("%9B", "%9%42"), "", 1), ("o", sent.replace("%9B", "%9%43"), "", 2)], schema)
    got = history.repeats(past, new, "id", {"form": "form_url", "home": "hp_url"}, "ord").collect()
    assert [tuple(r) for r in got] == [("n", "c")]


def test_repeats_equal_the_loop(spark):
    rng = random.Random(9)
    for n in range(4):
        url = lambda p: rng.choice(["", None, *(f"https://{p}{i}.example/x" for i in range(9))])
        past = [(f"p{i}", url("f"), url("h"), 0) for i in range(4)]
        new = [(f"b{i:02d}", url("f"), url("h"), rng.choice([i, 3])) for i in range(30)] + [(None, "https://f1.example/x", None, 1)]
        forms, homes, want = {}, {}, set()
        keep = lambda r: (r[1] and forms.setdefault(r[1], []).append(r[0]), r[2] and homes.setdefault(r[2], []).append(r[0]))
        for r in past:
            keep(r)
        for r in sorted((r for r in new if r[0]), key=lambda r: (r[3], r[0])):
            hit = {*(forms.get(r[1], []) if r[1] else []), *(homes.get(r[2], []) if r[2] else [])}
            want |= {(r[0], x) for x in hit}
            if not hit:
                keep(r)
        schema = "id string, form_url string, hp_url string, ord bigint"
        a, b = spark.createDataFrame(past, schema), spark.createDataFrame(new, schema)
        got = history.repeats(a.withColumn("token", F.lit(1)), b, "id", {"form": "form_url", "home": "hp_url"}, "ord")
        assert {tuple(r) for r in got.collect()} == want, n


def test_index_takes_batches_one_by_one(spark, tmp_path):
    rng = random.Random(12)
    url = lambda p: rng.choice(["", *(f"https://{p}{i}.example/x" for i in range(12))])
    schema = "id string, form_url string, hp_url string, ord bigint"
    kinds = {"form": "form_url", "home": "hp_url"}
    past = spark.createDataFrame([(f"p{i}", url("f"), url("h"), 0) for i in range(4)], schema)
    runs = [spark.createDataFrame([(f"b{k}{i:02d}", url("f"), url("h"), 100 * k + i) for i in range(8)], schema) for k in range(3)]
    index = history.Index.create(past, "id", kinds, str(tmp_path / "index"))
    got = set()
    for k, run in enumerate([*runs, runs[2]]):  # the last batch is run again
        got |= {tuple(r) for r in index.admit(run, "id", kinds, "ord", f"run{min(k, 2)}").collect()}
    whole = history.repeats(past, runs[0].unionAll(runs[1]).unionAll(runs[2]), "id", kinds, "ord")
    assert got == {tuple(r) for r in whole.collect()} and got


def test_repeats_of_nothing(spark):
    schema = "id string, form_url string, hp_url string, ord bigint"
    e, one = spark.createDataFrame([], schema), spark.createDataFrame([("a", "https://x.example", "", None), ("b", "https://x.example/?", "", None)], schema)
    kinds = {"form": "form_url", "home": "hp_url"}
    assert history.repeats(e, e, "id", kinds, "ord").count() == 0
    assert history.repeats(one, e, "id", kinds, "ord").count() == 0
    assert [tuple(r) for r in history.repeats(e, one, "id", kinds, "ord").collect()] == [("b", "a")]


# addresses

PLACES = [
    ("〒521-6264 千葉県白森市紺屋野110番地の9 セントラルコート 3F", "110-9"), ("紺屋野一一〇番地九 (千葉県白森市)", "110-9"), ("白森市　紺屋野　１１０の９", "110-9"), ("110-9, KONYANO, SHIROMORI-SHI, Chiba, Japan", "110-9"),
    ("Shiromori-shi Konyano 110-9", "110-9"), ("住所:千葉県白森市大字紺屋野110番地の9パークビル 901号室", "110-9"), ("ハーバータワー 5F、千葉県白森市紺屋野110-9", "110-9"), ("千葉県白森市紲屋野110－9", "110-9"),
]
NOT_SAME = ["千葉県白森市紺屋野110", "千葉県白森市紺屋野110-8", "千葉県白森市紺屋浜110-9", "東京都白森市紺屋野110-9", "千葉県白森市紺屋野1-10-9", "千葉県白森市紺屋野", "", None, "110-9", "千葉県深里市紺屋野110-9"]


@pytest.mark.parametrize("text, lot", PLACES)
def test_parse(text, lot):
    assert address.parse(text).lot == lot
    assert address.same_place(address.parse(text), address.parse(PLACES[0][0]))


def test_other_places():
    for text in NOT_SAME:
        assert not address.same_place(address.parse(text), address.parse(PLACES[0][0])), text


def test_numbers():
    assert [address.number(x) for x in ("12", "五十九", "三二六", "百二", "十", "千百")] == [12, 59, 326, 102, 10, 1100]
    assert address.lot_of("3丁目 38番地の20 901号室") == [3, 38, 20] and address.lot_of("6の34の51 6F") == [6, 34, 51] and address.lot_of("二丁目28番十五号オーク") == [2, 28, 15]


def test_same_places(spark):
    a = spark.createDataFrame([(str(i), t, "x") for i, (t, _) in enumerate(PLACES)] + [("n", None, ""), ("l", "あ" * 50_000, ""), ("0", PLACES[0][0], "")], "id string, address string, lot string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate([*NOT_SAME, PLACES[2][0], PLACES[2][0]])] + [(11, PLACES[3][0]), (None, PLACES[3][0])], "row_no bigint, a2 string")
    found = {tuple(r) for r in address.same_places(a, b, "id", "row_no", "address", "a2").collect()}
    everyone = {str(i) for i in range(len(PLACES))}
    assert {i for i, n in found if n == 10} == everyone and {n for i, n in found if i == "0"} == {10, 11}
    assert {i for i, n in found if n == 11} == everyone
    assert address.same_places(a.where("false"), b, "id", "row_no", "address", "a2").count() == 0


# names

STORED = [
    ("1", "株式会社秋葉コテフウ美容室", "美容室", "大阪府", "06-0012-9615", "大阪府梅根市緑中央8丁目38番22号"), ("2", "秋葉コテフウ美容室", "美容室", "大阪府", None, None), ("3", "秋葉 Kotefuu ヘアサロン", "美容室", "大阪府", "", ""),
    ("4", "北丘コテフウ美容室", "美容室", "大阪府", "06-0099-9615", ""), ("5", "秋葉コテラウ歯科", "歯科", "大阪府", "", ""), ("6", "", "美容室", "大阪府", "", ""), ("8", "山田ミクロ歯科", "歯科", "大阪府", "", "大阪府梅根市緑中央1-2-3"), ("7", None, "", "", "", ""), ("1", "株式会社秋葉コテフウ美容室", "美容室", "大阪府", "06-0012-9615", ""),
]
TYPED = [
    (1, "(株)秋葉・ｺﾃﾌｳ・美容", "", "大阪府", "", ""),  # other writing
    (2, "Akiba　KOTEFU 美容室", "美容室", "大阪府", "", ""),  # a slip in Latin letters
    (3, "コテフウ ヘア", "美容室", "大阪府", "", ""),  # two organisations, nothing decides
    (4, "コテフウ ヘア", "美容室", "大阪府", "０６００９９９６１５", ""),  # the phone decides
    (5, "コテ 美容室", "美容室", "大阪府", "", "梅根市緑中央 八丁目三十八番二十二号"),  # cut short, the address decides
    (6, "大秋葉コテフウ美容室", "美容室", "大阪府", "", ""),  # another place
    (7, "秋葉コテフウ美容室", "美容室", "東京都", "", ""),  # another area
    (11, "コテラウ 歯科", "", "大阪府", "", ""),  # no place, one organisation
    (8, "", "", "", "", ""), (9, None, None, None, None, None), (10, "あ" * 20_000, "", "", "", ""), (12, "ミクロ歯科", "", "大阪府", "", "大阪府梅根市緑中央1-2-4"), (13, "ミクロ歯科", "", "大阪府", "", ""),
]


def test_same_organisations(spark):
    cols = "name string, industry string, area string, phone string, address string"
    a = spark.createDataFrame([(*r, "clash") for r in STORED], f"id string, {cols}, org string")
    b = spark.createDataFrame(TYPED, f"row_no bigint, {cols}")
    c = {n: F.col(n) for n in ("name", "industry", "area", "phone", "address")}
    got = names.same_organisations(a, b, "id", "row_no", c, c)
    rows = sorted(map(tuple, got.collect()))
    by = {n: {i for i, m in rows if m == n} for n in range(1, 14)}
    assert by == {1: {"1", "2", "3"}, 2: {"1", "2", "3"}, 3: set(), 4: {"4"}, 5: {"1", "2", "3"}, 6: set(), 7: set(), 8: set(), 9: set(), 10: set(), 11: {"5"}, 12: set(), 13: {"8"}}
    assert len(rows) == len(set(rows))
    assert names.same_organisations(a.where("false"), b, "id", "row_no", c, c).count() == 0
    assert names.same_organisations(a, b.where("false"), "id", "row_no", c, c).count() == 0


def test_rows_without_an_area(spark):
    cols = "name string, industry string, area string, phone string, address string"
    stored = [
        ("1", "秋葉コテフウ美容室", "美容室", "大阪府", "", ""), ("2", "北丘コテフウ美容室", "美容室", "東京都", "06-0099-9615", ""), ("3", "北丘コテフウ美容室", "美容室", "大阪府", "", ""),
        ("4", "山田ミクロ歯科", "歯科", "", "", ""), ("5", "山田ミクロ歯科", "歯科", "大阪府", "", ""),
    ]
    typed = [
        (1, "秋葉コテフウ ヘア", "", "", "", ""), (2, "秋葉コテフ美容室", "美容室", None, "", ""), (3, "北丘コテフウ美容室", "", "", "", ""),  # 3: two areas, nothing decides
        (4, "北丘コテフウ美容室", "", "", "0600991111", ""), (5, "山田ミクロ歯科", "", "", "", ""), (6, "山田ミクロ歯科", "", "東京都", "", ""), (7, "ミクロ歯科", "", None, "", ""),
        (8, "北丘コテフウ美容室", "", "", "0600999615", ""),
    ]
    a, b = spark.createDataFrame(stored, f"id string, {cols}"), spark.createDataFrame(typed, f"row_no bigint, {cols}")
    c = {n: F.col(n) for n in ("name", "industry", "area", "phone", "address")}
    found = sorted(map(tuple, names.same_organisations(a, b, "id", "row_no", c, c).collect()))
    assert {n: {i for i, m in found if m == n} for n in range(1, 9)} == {1: {"1"}, 2: {"1"}, 3: set(), 4: set(), 5: {"4", "5"}, 6: {"4"}, 7: {"4", "5"}, 8: {"2"}}


def test_name_parts():
    n = names.parse("【雪川町】株式会社にしだい ミモヌセ リフォームスタジオ 様")
    assert n == names.Name("nishidai", "mimonuse", "工務店", "株式会社")
    assert names.parse("丸口トセ工建設").core == "tosee" and names.parse("YaeMenosoraHA") == names.Name("yae", "menosora", "美容室", "")
    assert names.parse("しろはまEMIMONUDC") == names.Name("shirohama", "emimonu", "歯科", "")
    assert names.parse("Asamoto税理士事務所ルヌトニ") == names.Name("asamoto", "runutoni", "税理士", "")
    assert names.core_likeness("sumuso", "suremuso") == 0.7 and names.core_likeness("suho", "suhorefu") == 0.8 and names.core_likeness("a", "b") == 0
