"""Clients, registries and the shapes of records."""

import pytest
from pyspark.sql import functions as F

from codeloom import external
from codeloom.operators import variants


def test_ask(spark):
    def client():
        def call(questions):
            if any(q == "bad" for q in questions):
                raise OSError("down")
            return [(q.upper(), len(q)) for q in questions]

        return call

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, q string")
    assert [(r.a, r.n) for r in external.ask(df, client, "q", "a string, n int").orderBy("id").collect()] == [("AB", 2), ("ABC", 3)]
    bad = spark.createDataFrame([(1, "bad")], "id int, q string")
    assert external.ask(bad, client, "q", "a string, n int").first()["a"] is None


def test_answers_and_registry(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    t = spark.createDataFrame([(1, 0.5), (1, 0.5)], "id int, p double")
    assert sorted((r.id, r.p) for r in external.answers(df, t, "id", ["p"]).collect()) == [(1, 0.5), (2, None)]

    @external.register("dd", "m")
    def build():
        return "built"

    assert external.load("dd", "m")() == "built"
    with pytest.raises(KeyError):
        external.load("dd", "other")


def test_sanitised(spark):
    df = spark.createDataFrame([("o", None, "int x;"), ("o", "", "no")], "o string, a string, b string")
    got = external.sanitised(df, "o", ["a", "b"], lambda c: F.contains(c, F.lit(";"))).collect()
    assert [(r.sanitised, r.fell_back) for r in got] == [("int x;", False), ("o", True)]


def test_candidates_and_batches(spark):
    df = spark.createDataFrame([(1, "int f(int a_b) { return a_b; }", "c"), (2, None, "c")], "id int, code string, language string")
    got = variants.candidates(df, "code", "language").orderBy("id").collect()
    assert len(got[0].output) == 4 and "aB" in got[0].output[0] and got[0].score == [1000, 3, 2, 1] and got[1].output == [None] * 4
    many = spark.range(100).select("id", (F.col("id") % 40).cast("int").alias("n"))
    sizes = variants.length_batches(many, F.col("n"), "id", 8).groupBy("batch").agg(F.count("*").alias("c"), (F.max("n") <= 2 * F.greatest(F.min("n"), F.lit(1))).alias("near"))
    assert sizes.agg(F.max("c")).first()[0] == 8 and sizes.agg(F.every("near")).first()[0]
    subs = F.array(F.struct(F.lit(" ").alias("code"), F.lit("c").alias("language")), F.struct(F.lit("x").alias("code"), F.lit("c").alias("language")))
    assert spark.range(1).select(variants.first_in_language(subs, "c"), variants.first_in_language(subs, "go")).first()[:] == ("x", None)
    assert spark.range(1).select(variants.defence_form(F.lit("a" * 9), "p:", 5, "!")).first()[0] == "p:aaaaa!"


def test_failures_are_told_and_endpoints_take_turns(spark):
    def down():
        def call(questions):
            raise OSError("down")

        return call

    df = spark.createDataFrame([(1, "x")], "id int, q string")
    assert external.ask(df, down, "q", "a string").first()["failure"] == "OSError: down"
    assert external.ask(df, lambda: lambda qs: [], "q", "a string").first()["failure"] == "wrong number of answers"
    assert external.ask(df, lambda: lambda qs: [("y",)], "q", "a string").first()["failure"] is None
    asked = []

    def first(x):
        asked.append("first")
        raise OSError

    def second(x):
        asked.append("second")
        return x + 1

    call = external.endpoints([first, second], tries=2, wait=0)
    assert [call(1), call(2)] == [2, 3] and asked == ["first", "second"] * 2
    with pytest.raises(OSError):
        external.endpoints([first], tries=2, wait=0)(1)
