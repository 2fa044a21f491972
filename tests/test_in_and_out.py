"""Control tables, redirects, payloads, limits, configuration, and the staged search for forms: nulls, ties, repeated rows, empty tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from leadloom.operators import catalog, pages, ranks, reports, runs, search
from leadloom.sources import export, readers, tables


def test_control_table_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "control")
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    readers.write_control(df, path)
    old = readers.read_control(spark, path)
    readers.write_control(df.where("id = 'b'"), path)
    assert old.count() == 2  # a reader of the version before still has it
    assert [tuple(r) for r in readers.read_control(spark, path).collect()] == [("b", None)]
    readers.drop_versions(spark, path)
    assert readers.read_control(spark, path).count() == 1
    readers.write_control(df.where("false"), path)
    assert readers.read_control(spark, path).count() == 0


def test_redirects(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("d", "d"), ("e", "gone"), *((f"n{i}", f"n{i + 1}") for i in range(8))]
    got = {r["url"]: (r["final_url"], r["hops"], r["error"]) for r in readers.followed(spark.createDataFrame(rows, "url string, location string")).collect()}
    assert len(got) == len(rows)
    assert got["a"] == ("c", 2, None) and got["c"] == ("c", 0, None) and got["d"] == ("d", 0, None) and got["e"] == ("gone", 1, None)
    assert got["x"][2] == got["n0"][2] == "too_many_redirects" and got["n7"] == ("n8", 1, None) and got["n3"] == ("n8", 5, None)
    assert readers.followed(spark.createDataFrame([], "url string, location string")).count() == 0


def test_long_pages_are_cut(spark):
    df = spark.createDataFrame([(1, "あ".encode() * 10, None), (2, None, "text/html"), (3, "日本".encode("cp932"), "text/html; charset=Shift_JIS")], "id int, raw binary, content_type string")
    assert {r["id"]: r["html"] for r in readers.decoded_pages(df, "id", most_bytes=6).collect()} == {1: "ああ", 2: "", 3: "日本"}


def test_payloads_are_bounded(spark):
    df = spark.createDataFrame([("r", f"{i:03d}", "x") for i in range(25)] + [("s", "1", None), (None, "2", "y")], "run_id string, id string, name string")
    got = {(r["run_id"], r["part"]): [i["id"] for i in r["items"]] for r in reports.payloads(df, "run_id", "id", ["name"], size=10).collect()}
    assert {k: len(v) for k, v in got.items()} == {("r", 0): 10, ("r", 1): 10, ("r", 2): 5, ("s", 0): 1, (None, 0): 1}
    assert got["r", 1] == [f"{i:03d}" for i in range(10, 20)]
    assert reports.payloads(df.where("false"), "run_id", "id", ["name"]).count() == 0


def test_ranks(spark):
    rows = [("a", i % 7, i) for i in range(300)] + [(None, None, 1), (None, 2, 2), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = sorted((r["rank"], r["x"], r["i"]) for r in ranks.global_rank(df, ["x", "i"]).collect())
    want = sorted(((x, i) for _, x, i in rows), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    assert [(x, i) for _, x, i in got] == want and [n for n, *_ in got] == list(range(1, len(rows) + 1))
    inside = {(r["g"], r["x"], r["i"]): r["rank"] for r in ranks.rank_in_group(df, "g", ["x", "i"]).collect()}
    assert inside[None, None, 1] == 1 and inside[None, 2, 2] == 2 and inside["b", 1, 1] == 1 and sorted(n for (g, *_), n in inside.items() if g == "a") == list(range(1, 301))
    assert ranks.global_rank(df.where("false"), ["x"]).count() == 0


def test_results_up_to_a_limit(spark):
    df = spark.createDataFrame([(q, i) for q in ("a", None) for i in range(50)] + [("b", 0)], "q string, i int")
    n = lambda limit: {r["q"]: r["n"] for r in search.capped_results(df, ["q"], "i", F.lit(limit)).groupBy("q").agg(F.count("*").alias("n")).collect()}
    assert n(20) == {"a": 20, None: 20, "b": 1} and n(21) == {"a": 40, None: 40, "b": 1} and n(0) == {}
    lim = spark.createDataFrame([(0, 1, 1), (None, 1, 1), (100, 3, 2), (5, 0, 0)], "m int, a int, w int")
    assert [r[0] for r in lim.select(search.limit_column(F.col("m"), F.col("a"), F.col("w"))).collect()] == [60, 60, 17, 5]
    both = search.concatenated([df.where("q = 'b'"), df.where("false"), df.where("q = 'b'")])
    assert sorted(r["part"] for r in both.collect()) == [0, 2]


def test_keyword_lists_are_trimmed(spark):
    df = spark.createDataFrame([(" a , ,b,",), (None,), ("",)], "w string")
    assert [r[0] for r in df.select(search.keyword_list(F.col("w"))).collect()] == [["a", "b"], [], []]


def test_node_tokens(spark):
    one = '{"n": [{"data": {"main": [[{"json": {"usage": {"prompt_tokens": %s, "completion_tokens": 2}}}, {"json": {"usage": {"prompt_tokens": 99}}}]]}}]}'
    rows = [("a", one % 5), ("b", "{}"), ("c", None), ("d", "?"), ("e", '{"n": [{"data": {"main": []}}], "m": [null]}'), ("f", one % "null")]
    got = {r["id"]: (r["tokens_input"], r["tokens_output"]) for r in runs.node_tokens(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    assert got == {"a": (5, 2), "b": (None, None), "c": (None, None), "d": (None, None), "e": (None, None), "f": (0, 2)}


def test_runs_that_are_busy_keep_their_rows(spark):
    r = spark.createDataFrame([("a", "success"), ("b", "running"), ("c", None), ("d", "error")], "id string, status string")
    c = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "c"), ("5", None), ("6", "z")], "id string, run_id string")
    left, gone = catalog.without_runs(c, r, ["a", "b", "c", "d", "z"])
    assert sorted(x["id"] for x in left.collect()) == ["3", "5", "6"]
    assert sorted(map(tuple, gone.collect())) == [("a", 2), ("c", 1), ("d", 0)]
    assert catalog.affected(c, F.col("run_id") == "a").first()[0] == 2 and catalog.affected(c.where("false"), F.lit(True)).first()[0] == 0


def test_configuration(spark):
    c = spark.createDataFrame([("run-001", True), ("run-999", None), ("x", False)], "id string, enabled boolean")
    ids = lambda df: sorted(map(tuple, df.collect()))
    assert ("run-1000", True) in ids(runs.with_new(c, {"enabled": True})) and ids(runs.with_new(c.where("false"), {})) == [("run-001", None)]
    assert len(ids(runs.without(c, "x"))) == 2 and ids(runs.without(c, "y")) == ids(c)
    assert ("run-999", True) in ids(runs.toggled(c, "run-999")) and ("run-001", False) in ids(runs.toggled(c, "run-001"))
    assert runs.next_by_count(c, "id", "run-").first()[0] == "run-003" and runs.next_number(c, "id", "run-").first()[0] == "run-1000"


def test_counts_of_rows_without_something(spark):
    df = spark.createDataFrame([("1", "", "03", "a@b"), ("2", None, "", ""), ("3", "f", "03", "")], "id string, form_url string, phone string, email string")
    assert tuple(catalog.counts(df, catalog.Filter(has_form=False, has_phone=False)).first()) == (2, 0, 0, 1)


def test_areas_that_could_not_be_looked_up_pass(spark):
    df = spark.createDataFrame([(1, "東京都", False), (2, "x", True), (3, "x", None), (4, None, False), (5, "", False)], "id int, area string, failed boolean")
    known = spark.createDataFrame([("東京都",), ("東京都",)], "value string")
    assert {r["id"]: r["valid"] for r in reports.known_areas(df, "area", known, F.col("failed")).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_one_header_in_an_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(f"c{i:03d}", f'a"{i}') for i in range(50)], "id string, name string")
    full = df.select("*", *(F.lit(None).cast("string").alias(c) for c in export.LOCALISED.values() if c not in df.columns))
    export.write_csv(full, path, ["id"])
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode("utf-8")
    lines = text.splitlines()
    assert text.startswith("﻿会社名,") and text.count("﻿") == 1 and len(lines) == 51 and lines[1].startswith('"a""0"') and lines[50].startswith('"a""49"')


FORM = '<form><input type="text" name="name"><input type="email"><textarea></textarea><button>送信</button></form>'


def test_forms_are_found_in_stages(spark):
    homes = spark.createDataFrame(
        [("1", "https://a.example/", None, '<a href="/contact/">お問い合わせ</a>'), ("2", "https://b.example/", "https://www.coubic.com/b", "x"), ("3", "https://c.example/", None, FORM), ("4", "https://d.example/", None, None),
         ("5", "https://x.coubic.com/e", None, "<p>" + "長い" * 100_000), ("6", None, None, ""), ("7", "https://g.example/", None, '<a href="/contact/">お問い合わせ</a>'), ("8", "", "", "<p>x</p>")],
        "id string, url string, final_url string, html string",
    ).withColumn("links", F.lit("clash"))
    fetched = spark.createDataFrame([("https://a.example/contact/", "https://a.example/contact/?utm_source=1", 200, FORM), ("https://g.example/contact/", None, 500, FORM)], "url string, final_url string, status_code int, html string")
    got = {r["id"]: (r["form_url"], r["stage"]) for r in pages.found_forms(homes, fetched, "id").collect()}
    assert got == {"1": ("https://a.example/contact/", "primary"), "2": ("https://www.coubic.com/b", "redirect"), "3": ("https://c.example/", "primary"), "5": ("https://x.coubic.com/e", "booking")}
    assert pages.found_forms(homes.where("false"), fetched, "id").count() == 0
    assert pages.found_forms(homes, fetched.where("false"), "id").count() == 3


def test_base_of_links():
    link = '<a href="x">x</a>'
    url = lambda head, at="https://a.example/p/": [x["url"] for x in pages.read_page(head + link, at)["links"]]
    assert url("") == ["https://a.example/p/x"] and url('<link rel="canonical" href="/en/">') == ["https://a.example/en/x"]
    assert url('<link rel="canonical" href="https://cdn.example/en/">') == ["https://a.example/p/x"] and url('<base href="/b/">') == ["https://a.example/b/x"]
    assert url('<link rel="canonical" href="https://[bad">') == ["https://a.example/p/x"]


def test_structured_facts(spark):
    ld = '<script type="application/ld+json">{"email": "a@b.example", "telephone": 3, "address": "東京都"}</script>'
    df = spark.createDataFrame([(1, ld, "k"), (2, None, "k"), (3, "<p>" + "x" * 100_000, "k"), (4, ld.replace("{", "{{"), "k")], "id int, html string, ld string")
    got = {r["id"]: (r["ld_email"], r["ld_phone"], r["ld_address"], r["ld"]) for r in pages.structured_facts(df, "id").collect()}
    assert got == {1: ("a@b.example", "", "東京都", "k"), 2: ("", "", "", "k"), 3: ("", "", "", "k"), 4: ("", "", "", "k")}


def test_a_cluster_needs_a_shared_folder():
    nothing = SimpleNamespace(get=lambda *a: "", isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: nothing)))
    with pytest.raises(ValueError):
        tables.scratch_dir(SimpleNamespace(sparkContext=sc, conf=nothing))


def test_scratch_tables(spark):
    assert tables.scratch(spark).startswith(tables.scratch_dir(spark).rstrip("/"))
    held = tables.cut(spark.range(3))
    assert held.count() == 3
