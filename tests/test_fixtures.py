"""Hand-computed metric fixtures and text expressions."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scores, text
from codeloom.operators import bleu, lookup, metrics, passk, profile, quality, ranking, sampling


def one(df):
    return df.first()[0]


def test_binary(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1], strict=True)), "pred int, label int")
    r = df.agg(*metrics.binary()).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (80.0, 66.666667, 100.0, 80.0)


def test_rates(spark):
    df = spark.createDataFrame([(p, 1) for p in [0, 0, 0, 1, 1]], "pred int, label int")
    assert one(df.agg(metrics.success_rate())) == 60.0
    assert one(df.where("label = 0").agg(metrics.success_rate())) == 0.0


@pytest.mark.parametrize(("c", "n", "k", "want"), [(1, 4, 1, 0.25), (2, 4, 2, 0.833333), (0, 4, 4, 0.0), (1, 4, 4, 1.0), (0, 1, 2, 1.0)])
def test_pass_at_k(spark, c, n, k, want):
    df = spark.createDataFrame([(n, c)], "n int, c int")
    assert round(one(df.select(passk.pass_at_k(F.col("n"), F.col("c"), k))), 6) == want


def test_pass_at_k_other_form(spark):
    assert one(spark.createDataFrame([(1, 0)], "n int, c int").select(passk.pass_at_k(F.col("n"), F.col("c"), 2, compat=False))) is None


def test_auroc(spark):
    df = spark.createDataFrame(list(zip([0.1, 0.4, 0.35, 0.8, 0.4], [False, True, False, True, False], strict=True)), "s double, y boolean")
    assert one(metrics.auroc(df, "s", "y")) == 0.916667
    assert one(metrics.auroc(df.where("y"), "s", "y")) is None


def test_ranks(spark):
    df = spark.createDataFrame([(1, 0.9, True), (1, 0.9, False), (1, 0.1, False)], "b int, s double, right boolean")
    assert passk.reciprocal_ranks(df, "b", "s", F.col("right")).first()["rank"] == 2
    assert passk.attack_ranks(df, "b", "s", F.col("right")).first()["rank"] == 1


def test_weighted_inference(spark):
    df = spark.createDataFrame([([-0.5, -1.0, -2.0, -0.1], [0.2, 0.9, 0.4, 0.6])], "s array<double>, v array<double>")
    a, b = df.select(scores.weighted(F.col("s"), F.col("v")), scores.weighted_pairs(F.col("s"), F.col("v"))).first()
    assert round(a, 6) == round(b, 6) == 0.520919
    assert one(df.select(scores.majority(F.array(*[F.lit(x) for x in (1, 1, 0, 0)])))) == 1
    assert one(df.select(scores.argmax(F.col("s")))) == 3


def test_fnv_and_seconds(spark):
    df = spark.createDataFrame([("abc",), ("p1",), ("",)], "s string")
    assert [r[0] for r in df.select(text.fnv1a(F.col("s"))).collect()] == [440920331, 2689521274, 2166136261]
    df = spark.createDataFrame([(None,), ("1",), ("1000",), ("1001",), ("x",)], "s string")
    assert [r[0] for r in df.select(text.seconds(F.col("s"))).collect()] == [6, 1, 1, 2, 6]


def test_percentile(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    assert df.agg(*profile.lengths("x")).first()["p90"] == 7.9


def test_reasons(spark):
    rows = [None, "", "  \n", "a" * 9, "a" * 10, "a" * 10000, "a" * 10001]
    df = spark.createDataFrame([(x,) for x in rows], "c string")
    assert [r[0] for r in df.select(quality.code_reason(F.col("c"))).collect()] == ["missing", "blank", "blank", "too_short", None, None, "too_long"]


def test_positions(spark):
    index = spark.createDataFrame([("0",), (" 2 ",), ("-1",), ("9",), ("x",), ("1",)], "value string").withColumn("at", lookup.to_int(F.col("value")))
    table = spark.createDataFrame([(0, "a"), (2, "c")], "pos int, v string")
    got = {r.value.strip(): r.outcome for r in lookup.by_position(index, table, "pos", 0, 5).collect()}
    assert got == {"0": "found", "2": "found", "-1": "out_of_range", "9": "out_of_range", "x": "not_a_number", "1": "missing"}


def test_keep_last_and_carry(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in lookup.keep_last(df.withColumn("o2", F.col("o")), ["k"], ["o2"]).collect()} == {("a", "y"), ("b", "z")}
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("a", 4, None)], "k string, o int, v string")
    assert [r.v for r in lookup.carry_forward(df, "k", "o", "v").orderBy("o").collect()] == ["x", "x", "y", "y"]


def test_zip_lines_refuses(spark):
    a = spark.createDataFrame([(0, "x")], "line int, a string")
    with pytest.raises(ValueError, match="lines"):
        lookup.zip_lines(a, a.limit(0).withColumnRenamed("a", "b"), "line")


def test_key_chain(spark):
    left = spark.createDataFrame([("n1", None), (None, "t2"), ("n3", "t1")], "name string, task string")
    right = spark.createDataFrame([("n1", "t1", 5), ("n2", "t2", 7)], "n string, t string, v int")
    got = [r.v for r in lookup.by_key_chain(left, right, [("name", "n"), ("task", "t")], "v").collect()]
    assert sorted(got) == [5, 5, 7]


def test_bleu(spark):
    same = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split())], "id int, h array<string>, r array<string>")
    assert one(bleu.corpus_bleu(same, "id", "h", "r")) == 1.0
    none = spark.createDataFrame([(1, ["x"], ["y"])], "id int, h array<string>, r array<string>")
    assert one(bleu.corpus_bleu(none, "id", "h", "r")) == 0.0
    part = spark.createDataFrame([(1, "a b c d".split(), "a b c d e f".split())], "id int, h array<string>, r array<string>")
    assert abs(one(bleu.corpus_bleu(part, "id", "h", "r")) - 0.606531) < 1e-6  # exp(1 - 6/4)


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = ranking.hash_rank(df.repartition(3), "s", "k").agg(F.sum(F.hash("k", "rank")), F.max("rank"), F.count_distinct("rank")).first()
    b = ranking.hash_rank(df.repartition(11), "s", "k").agg(F.sum(F.hash("k", "rank")), F.max("rank"), F.count_distinct("rank")).first()
    assert a == b and a[1] == a[2] == 5000


def test_score_ranks(spark):
    df = spark.createDataFrame([(float(x % 7),) for x in range(100)] + [(None,)], "s double")
    got = {r.s: (r.n, r.before) for r in ranking.score_ranks(df, "s", 4).collect()}
    want, at = {}, 0
    for v in range(7):
        n = sum(x % 7 == v for x in range(100))
        want[float(v)] = (n, at)
        at += n
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, t int")
    assert ranking.hash_rank(none, "s", "k").count() == 0
    assert sampling.sample_ratio(none, 0.5, "s", "k").count() == 0
    assert sampling.sample_strata(none, 0.5, "s", "k", "t").count() == 0
    assert none.withColumn("pred", F.col("k")).withColumn("label", F.col("t")).agg(*metrics.binary()).first()["accuracy"] == 0.0
    with pytest.raises(ValueError, match="few"):
        sampling.bands(none, [("a", 1)], "s", "k")


def test_purify(spark):
    df = spark.createDataFrame([("a b  c", ["a", "b", "c"], [0.0, 9.0, 1.0])], "t string, w array<string>, s array<double>")
    assert one(df.select(scores.purify(F.col("t"), F.col("w"), F.col("s"), F.lit(5.0)))) == "a c"
    assert one(df.select(scores.purify(F.col("t"), F.col("w"), F.col("s"), F.lit(50.0)))) == "a b  c"
    assert df.select(scores.without_each(F.col("w"))).first()[0] == ["b c", "a c", "a b"]


def test_text_forms(spark):
    df = spark.createDataFrame([("ESC",)], "x string")
    ident = df.select(text.parse_variant_id(F.lit("CPP-012-7")).alias("p"), text.parse_variant_id(F.lit("odd")).alias("q"), text.variant_id(F.lit("c"), F.lit(5), F.lit(1)).alias("r")).first()
    assert (ident.p.language, ident.p.number, ident.p.variant) == ("CPP", 12, 7) and ident.q.number is None and ident.r == "C-005-1"
    assert "return 0;" in one(df.select(text.detokenise(F.array(*[F.lit(x) for x in ["int", "main", "(", ")", "{", "return", "0", ";", "}"]]))))
    assert one(df.select(text.marked(F.lit("x [A] ```c\nint a;\n``` y"), "[A]"))) == "int a;"
