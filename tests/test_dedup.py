import random

from pyspark.sql import functions as F

from leadloom.operators import dedup


def loop(stored, batch):
    """The rule read as a loop over the batch in order."""
    forms, homes = {r[1] for r in stored if r[1]}, {r[2] for r in stored if r[2]}
    out, candidates, new = {}, [], []
    for r in sorted(batch, key=lambda r: (r[4], r[0])):
        rid, f, h, url, _ = r
        if f and f in forms:
            out[rid] = ("duplicate", None)
        elif h and h in homes:
            if f and url:
                candidates.append(r)
                forms.add(f)
            else:
                out[rid] = ("duplicate", None)
        else:
            out[rid] = ("insert", None)
            new.append(r)
            homes |= {h} - {""}
            forms |= {f} - {""}
    free = {}
    for r in sorted((r for r in stored if not r[3] and r[2]), key=lambda r: r[0]) + [r for r in new if not r[3] and r[2]]:
        free.setdefault(r[2], []).append(r[0])
    for rid, _, h, _, _ in candidates:
        out[rid] = ("upgrade", free[h].pop(0)) if free.get(h) else ("duplicate", None)
    return out


def test_upsert_plan_equals_the_loop(spark):
    rng = random.Random(5)
    for n in range(6):
        make = lambda p, i: (f"{p}{i:03d}", (f := rng.choice(["", "", "f1", "f2", "f3", "f4"])), rng.choice(["", "h1", "h2", "h3"]), f and "u" + f)
        stored = [make("s", i) for i in range(rng.randrange(8))]
        batch = [(*make("b", i), i) for i in range(rng.randrange(25))]
        a = spark.createDataFrame(stored, "id string, form_key string, home_key string, form_url string")
        b = spark.createDataFrame(batch, "id string, form_key string, home_key string, form_url string, ord bigint")
        got = {r["id"]: (r["decision"], r["target_id"]) for r in dedup.upsert_plan(a, b).collect()}
        assert got == loop(stored, batch), n


def test_second_upsert_adds_nothing(spark):
    cols = "id string, form_key string, home_key string, form_url string, form_type string, phone string, email string, address string"
    stored = spark.createDataFrame([("s", "", "h", "", "", "1", "", "")], cols)
    batch = spark.createDataFrame([("a", "f", "h", "u", "LINE", "2", "e", None, 1), ("b", "g", "i", "v", "", "", "", "", 2)], cols + ", ord bigint")
    plan = dedup.upsert_plan(stored, batch)
    after = dedup.upserted(stored, batch, plan)
    rows = {r["id"]: r.asDict() for r in after.collect()}
    assert rows["s"]["form_url"] == "u" and rows["s"]["phone"] == "1" and rows["s"]["email"] == "e" and set(rows) == {"s", "b"}
    counts = dedup.upsert_counts(dedup.upsert_plan(after, batch)).first()
    assert (counts["added"], counts["upgraded"], counts["duplicates"]) == (0, 0, 2)


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("", 3, "z"), (None, 4, "w"), ("a", 1, "y")], "k string, o int, v string")
    assert sorted(r["v"] for r in dedup.first_wins(df, ["k"], ["o"]).collect()) == ["w", "y", "z"]
    assert {r["v"] for r in dedup.last_wins(df.where("k = 'a'"), ["k"], ["o"]).collect()} == {"x"}
    assert dedup.first_wins(df.where("false"), ["k"], ["o"]).count() == 0


def test_places_keep_rows_without_host(spark):
    df = spark.createDataFrame([("p1", "h", 1), ("p1", "g", 2), ("p2", "h", 3), ("p3", "", 4), ("p4", "", 5)], "place string, host string, o int")
    assert sorted(r["o"] for r in dedup.places(df, "place", "host", "o").collect()) == [1, 4, 5]


def test_shuffled_partitions_give_the_same(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("string").alias("k"), F.col("id").alias("o"))
    want = {r["o"] for r in dedup.first_wins(df, ["k"], ["o"]).collect()}
    assert want == {r["o"] for r in dedup.first_wins(df.repartition(7, F.rand(3)), ["k"], ["o"]).collect()} == set(range(50))


def test_resolved_type(spark):
    df = spark.createDataFrame([(True, "booking"), (False, "booking"), (False, "inquiry"), (False, None)], "line boolean, given string")
    assert [r[0] for r in df.select(dedup.resolved_type(F.col("line"), F.col("given"))).collect()] == ["LINE", "reservation", "inquiry", ""]
