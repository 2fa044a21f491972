from pyspark.sql import functions as F

from leadloom.functions.lists import LOCALISED, WORKFLOW_SKIPPED
from leadloom.operators import catalog, classify, limits, runs, search
from leadloom.sources import export, readers

COMPANY = "id string, name string, hp_url string, form_url string, phone string, email string, address string, industry string, area string, form_type string, status string, notes string, project_id string, run_id string, collected_at string"


def companies(spark, *rows):
    names = [c.split(" ")[0] for c in COMPANY.split(", ")]
    return spark.createDataFrame([tuple({"id": str(i), **r}.get(n) for n in names) for i, r in enumerate(rows)], COMPANY)


def test_filters(spark):
    df = companies(spark, {"name": "100% Cafe", "phone": "1"}, {"name": "1000 cafe", "form_url": "u"}, {"notes": "a_b"}, {})
    ids = lambda **f: sorted(r["id"] for r in catalog.rows(df, catalog.Filter(**f)).collect())
    assert ids(search="0% C") == ["0"] and ids(search="CAFE") == ["0", "1"] and ids(search="a_b") == ["2"]
    assert ids(has_form=True) == ["1"] and ids(has_form=False) == ["0", "2", "3"] and ids(has_phone=True) == ["0"] and ids(has_phone=False) == ["0", "1", "2", "3"] and ids(ids=["3"]) == ["3"]


def test_page_sorts_and_clamps(spark):
    df = companies(spark, *[{"name": n} for n in ("b", "a", "a", None)])
    assert [r["id"] for r in catalog.page(df, catalog.Filter(), "name", False, 1, 3).collect()] == ["1", "2", "0"]
    assert catalog.page(df, catalog.Filter(), "bad", True, 0, 0).count() == 1


def test_times(spark):
    df = companies(spark, {"collected_at": "2026/4/9 0:54:09"}, {"collected_at": "2026-04-08T15:54:09.000Z"}, {"collected_at": "?"}, {})
    ms = [r[0] for r in df.select(F.unix_millis(catalog.instant(F.col("collected_at")))).collect()]
    assert ms[0] == ms[1] and ms[2:] == [None, None]


def test_roll_up(spark):
    cols = "id string, status string, child_run_ids array<string>, items_written bigint, tokens_input bigint, tokens_output bigint, raw_search_count bigint, completed_at string"
    df = spark.createDataFrame(
        [("p", "running", ["a", "b"], None, None, None, None, None), ("a", "success", None, 3, 0, None, 5, "x"), ("b", "error", [], None, None, 0, None, "x"), ("q", "running", ["a", "c"], 0, 0, 0, 0, None),
         ("c", "pending", None, 1, 1, 1, 1, None), ("r", "success", ["a"], 3, None, None, None, "x")], cols)
    rows = {r["id"]: r.asDict() for r in runs.rolled_up(df).collect()}
    assert set(rows) == {"p", "r"} and rows["p"]["status"] == "success" and rows["p"]["items_written"] == 3 and rows["p"]["tokens_input"] is None and rows["p"]["raw_search_count"] == 5
    assert [r["id"] for r in runs.roll_up_needed(df).collect()] == ["p"]


def test_durations(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "2026-01-01 02:03:04"), ("2026-01-01 00:00:00", "2026-01-01 00:03:04"), ("2026-01-02 00:00:00", "2026-01-01 00:00:00")], "a string, b string")
    t = lambda c: F.col(c).cast("timestamp")
    assert [r[0] for r in df.select(runs.duration_text(t("a"), t("b"))).collect()] == ["2時間3分", "3分4秒", "-"]


def test_latest_values(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (1, 3, "b", None), (2, 1, None, None)], "k int, o int, s string, e string")
    assert sorted(map(tuple, runs.latest_values(df, "k", "o", ["s", "e"]).collect())) == [(1, "b", "x"), (2, None, None)]


def test_synonyms(spark):
    cases = [(["美容室", "美容院", "ネイル"], ["美容室", "ネイル"]), (["整骨院", "接骨院"], ["整骨院"]), (["中古車販売", "中古車"], ["中古車販売", "中古車"]), ([], []), (["塾"], ["塾"])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "w array<string>")
    assert [r[0] for r in df.select(search.without_synonyms(F.col("w"))).collect()] == [w for _, w in cases]


def test_keywords(spark):
    df = spark.createDataFrame([("歯科", ["", " ", "矯正"], 2), ("歯科", None, 2)], "i string, w array<string>, n int")
    assert [r[0] for r in df.select(search.keywords_for(F.col("i"), F.col("w"), F.col("n"))).collect()] == [["歯科", "矯正"], ["歯科"]]
    assert search.limit_per_query(0, 5, 2) == 60 and search.limit_per_query(100, 3, 2) == 17


def test_limiter_counts_accepted_only(spark):
    seconds = [0, 10, 20, 61, 62, 75]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(seconds)] + [(None, 100, 0), (None, 101, 1)], "k string, o int, s int").withColumn("at", F.timestamp_seconds("s"))
    got = dict(map(tuple, limits.limited(df, "k", "at", "o", 2, 60).collect()))

    def loop(times):
        log, out = [], []
        for t in times:
            log = [x for x in log if x > t - 60]
            out.append(len(log) < 2)
            if out[-1]:
                log.append(t)
        return out

    assert [got[i] for i in range(len(seconds))] == loop(seconds) and got[100] and got[101]


def test_longest_runs_and_sessions(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("eeoeeeo")], "k int, o int, x string").withColumn("at", F.timestamp_seconds(F.col("o") * 100))
    assert limits.longest_runs(df, "k", "o", F.col("x") == "e").first()["longest"] == 3
    assert limits.sessions(df, "k", "at", 100).count() == 1 and limits.sessions(df, "k", "at", 99).count() == 7


def test_classes(spark):
    df = spark.createDataFrame([("予約 カレンダー",), ("お問い合わせ",), (None,)], "t string")
    assert [r[0] for r in df.select(classify.by_words(F.col("t"))).collect()] == ["booking", "inquiry", "unknown"]
    assert [r[0] for r in df.select(classify.by_page(F.col("t"), F.lit(""))).collect()] == ["booking", "inquiry", "unknown"]
    replies = spark.createDataFrame([('ok {"type": "LINE", "reason": "x"} end',), ("none",), (None,)], "t string")
    assert [r[0] for r in replies.select(classify.json_answer(F.col("t"))).collect()] == ["LINE", "unknown", "unknown"]
    c = spark.createDataFrame([("https://coubic.com/x/contact", "inquiry"), ("https://coubic.com/x/book", "inquiry"), ("https://ssl.haisha-yoyaku.jp/", "unknown"), ("https://lin.ee/x", ""), (None, None)], "form_url string, form_type string")
    assert [r["new_type"] for r in classify.reclassified(c).collect()] == ["inquiry", "reservation", "reservation", "LINE", None]


def test_model_hook(spark):
    df = spark.createDataFrame([("a", "inquiry"), ("b", "inquiry")], "t string, hint string")
    out = classify.by_model(df, "t", "hint", lambda s: s.map({"a": "LINE", "b": "nonsense"}))
    assert [r["type"] for r in out.orderBy("t").collect()] == ["LINE", "inquiry"]


def test_csv(spark, tmp_path):
    df = companies(spark, {"name": 'a"b,c\nd'}, {"name": None})
    lines = {r["id"]: r["line"] for r in export.csv_lines(df).collect()}
    assert lines["0"].startswith('"a""b,c\nd","",') and lines["1"].count(",") == len(LOCALISED) - 1
    assert export.csv_header().startswith("﻿会社名,HP URL")
    export.write_csv(df, str(tmp_path / "out"), ["id"])
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("﻿会社名") and '"a""b,c' in text


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('会社名,HP URL\n"a ""x""",\n', "utf-8")
    assert tuple(readers.read_sheet(spark, str(tmp_path / "s.csv")).first()) == ('a "x"', "")
    (tmp_path / "c.json").write_text('{"runs": [{"area": "全国"}]}', "utf-8")
    assert readers.read_config(spark, str(tmp_path / "c.json")).first()["runs"][0]["area"] == "全国"
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("hp_url", T.StringType())])
    df = spark.createDataFrame([("r1", '[{"name":"a"},{"name":" "},{"hp_url":"u"}]'), ("r2", "{broken"), ("r3", None)], "run string, body string")
    assert sorted((r["run"], r["name"], r["hp_url"]) for r in readers.parsed_records(df, "body", schema).collect() if r["name"]) == [("r1", "a", None)]
    raw = spark.createDataFrame([(1, bytearray("日本".encode("cp932")), "text/html; charset=Shift_JIS"), (2, bytearray('<meta charset="euc-jp">日本'.encode("euc_jp")), ""), (3, bytearray(b"\xff"), None), (4, None, None)], "id int, raw binary, content_type string")
    assert [r["html"] for r in readers.decoded_pages(raw, "id").orderBy("id").collect()] == ["日本", '<meta charset="euc-jp">日本', "�", ""]


def test_the_workflow_skips_its_own_list(spark):
    hosts = ["bestsalonreport.jp", "www.pathee.com", "a.judo-ch.jp", "hairsalon-map.com", "beauty-park.jp", "notpathee.com", "a.example"]
    df = spark.createDataFrame([(f"https://{h}/x",) for h in hosts], "link string")
    assert [r["host"] for r in search.organic(df, "link", WORKFLOW_SKIPPED).collect()] == ["notpathee.com", "a.example"]
    assert len(WORKFLOW_SKIPPED) == len(set(WORKFLOW_SKIPPED)) == 75
