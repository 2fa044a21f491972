from pyspark.sql import functions as F

from leadloom.operators.copies import Compared, differences

SCHEMA = "k string, s string, o bigint, side int, id string"


def diff(spark, left, right, ordered=True):
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    out = differences(a, b, a["k"], b["k"], [Compared("s", a["s"], b["s"])], "left", "right", right_order=b["o"] if ordered else None)
    return sorted(map(tuple, out.collect()))


def row(k, s, o=0):
    return (k, s, o, 7, "other")


def test_missing_and_different(spark):
    left = [row("a", "x"), row("b", " y　"), row("c", None), row(None, "x"), row("d", "1")]
    right = [row("b", "y"), row("c", "\xa0"), row("d", "2"), row("e", ""), row(None, "z")]
    assert diff(spark, left, right) == [("a", "left"), ("d", "s"), ("e", "right")]


def test_last_row_counts_and_ties(spark):
    left = [row("a", "new"), row("b", "z")]
    right = [row("a", "old", 5), row("a", "new", 9), row("a", "old", 5), row("b", "q", 1), row("b", "z", 1), row("b", "x", None)]
    assert diff(spark, left, right) == []
    assert diff(spark, left, right, ordered=False) == [("a", "s")]


def test_empty_sides(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [row("a", "x")], []) == [("a", "left")]
    assert diff(spark, [], [row("a", "x")]) == [("a", "right")]


def test_long_values_and_hot_key(spark):
    right = [row("hot", str(i), i) for i in range(2000)] + [row(f"k{i}", "v" * 200_000) for i in range(5)]
    left = [row("hot", "1999")] + [row(f"k{i}", "v" * 200_000 + ("!" if i == 3 else "")) for i in range(5)]
    assert diff(spark, left, right) == [("k3", "s")]


def test_plan_has_one_range_exchange(spark, capsys):
    a = spark.range(10).select(F.col("id").cast("string").alias("k"))
    differences(a, a, a["k"], a["k"], [], "l", "r").explain()
    assert capsys.readouterr().out.count("rangepartitioning") == 1
