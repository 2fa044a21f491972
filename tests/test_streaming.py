from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.streaming import jobs

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType())])


def files(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k string, s int, kind string").select("k", F.timestamp_seconds("s").alias("at"), "kind")
    df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return jobs.incoming(spark, str(tmp_path / "in"), SCHEMA)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_window_counts(spark, tmp_path):
    stream = files(spark, tmp_path, [("a", 1, "x"), ("a", 2, "x"), ("a", 70, "y"), ("a", 10_000, "x")])
    run(jobs.counts(stream, "at", "1 minute", "1 second", "kind"), "windows")
    assert sorted((r["kind"], r["n"]) for r in spark.table("windows").collect()) == [("x", 2), ("y", 1)]


def test_append_new_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "table")
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    for epoch in (0, 1):
        jobs.append_new(target, "k", "o")(batch, epoch)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("a", 1), ("b", 3)]


def test_limiter(spark, tmp_path):
    stream = files(spark, tmp_path, [("a", s, "x") for s in (1000, 1010, 1020, 1061, 1062)])
    run(jobs.limited(stream, "k", "at", 2, 60), "limited")
    assert [r["accepted"] for r in spark.table("limited").orderBy("at").collect()] == [True, True, False, True, False]
