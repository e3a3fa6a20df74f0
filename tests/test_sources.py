"""Readers and sinks on temporary folders, with the odd rows every reader must bear."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from codeloom.sources import readers, writers


@pytest.fixture
def place(tmp_path):
    return lambda name, content: (tmp_path / name).write_text(content) and str(tmp_path / name) or str(tmp_path / name)


def test_json_lines(spark, place):
    path = place("a.jsonl", '{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    good, bad = readers.jsonl_lenient(spark, path, "a int, b string")
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x"), (2, None)] and [r.value for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        readers.jsonl_strict(spark, path, "a int, b string").collect()


def test_shards(spark, tmp_path):
    for split, names in (("train", ["a.jsonl.gz", "b.jsonl.gz"]), ("test", ["c.jsonl.gz"])):
        (tmp_path / split).mkdir()
        for n in names:
            with gzip.open(tmp_path / split / n, "wt") as f:
                f.write("".join(json.dumps({"v": f"{n[0]}{i}"}) + "\n" for i in range(3)))
    df = readers.gz_shards(spark, {"train": str(tmp_path / "train"), "test": str(tmp_path / "test")}, "v string", "idx")
    assert [(r.idx, r.v) for r in df.orderBy("idx").collect()] == list(enumerate(["a0", "a1", "a2", "b0", "b1", "b2", "c0", "c1", "c2"]))


def test_arrays_csv_parquet(spark, place, tmp_path):
    a = place("a.json", '[{"x": 1, "y": "p"}, {"x": 2, "y": "q"}]')
    b = place("b.json", '{"data": [{"x": 3, "y": "r"}]}')
    assert sorted(r.x for r in readers.json_array(spark, a, "x int, y string").collect()) == [1, 2]
    assert [r.x for r in readers.json_array(spark, b, "x int, y string").collect()] == [3]
    c = place("c.csv", 'x,y\n1,"a,b"\n2,"line\nbreak"\n')
    assert sorted(r.y for r in readers.csv(spark, c, "x int, y string").collect()) == ["a,b", "line\nbreak"]
    p = str(tmp_path / "p")
    assert writers.parquet(spark.createDataFrame([(1, "a")], "x int, y string"), p)
    assert readers.parquet(spark, p, ["y", "z"]).columns == ["y"]
    assert not writers.parquet(spark.createDataFrame([], "x int"), str(tmp_path / "none"))


def test_delimited(spark, place):
    path = place("a.tsv", "src\ttgt\na\tb\nbad\nc\td\te\n")
    good, bad = readers.delimited(spark, path, "\t", ["src", "tgt"], header=True)
    assert [(r.src, r.tgt) for r in good.collect()] == [("a", "b")] and bad.count() == 2
    path = place("a.txt", "1<CODESPLIT>u<CODESPLIT>v\n1<CODESPLIT>u\n")
    good, bad = readers.delimited(spark, path, "<CODESPLIT>", ["label", "a", "b"])
    assert good.count() == bad.count() == 1


def test_small_files(spark, place):
    good, bad = readers.triples(spark, place("p.txt", "a b 1\n a\tc 0 \nx y\na b c d\n\n"))
    assert sorted((r.idx2, r.label) for r in good.collect()) == [("b", 1), ("c", 0)] and bad.count() == 2
    assert sorted(r.value for r in readers.int_lines(spark, place("i.txt", "1\n 2 \nx\n\n-1\n")).collect()) == [-1, 1, 2]
    a, b = place("s.buggy", "x\n\nz\n"), place("s.fixed", "X\nY\nZ\n")
    assert sorted((r.buggy, r.fixed) for r in readers.parallel(spark, a, b, ("buggy", "fixed")).collect()) == [("x", "X"), ("z", "Z")]
    with pytest.raises(ValueError, match="lines"):
        readers.parallel(spark, a, place("t.fixed", "X\n"), ("buggy", "fixed"))


def test_tasks_and_splits(spark):
    df = spark.createDataFrame([(" a \n b", "c")], "buggy string, fixed string")
    assert readers.examples(df, "refine", 1).first()["source"] == "a b"
    rows = spark.createDataFrame([(i, "Train ") for i in range(20)] + [(99, "test"), (98, None)], "id int, s string")
    n = {r.split: r["count"] for r in readers.load_splits(rows, "s", "id").groupBy("split").count().collect()}
    assert n == {"train": 18, "valid": 2, "test": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["c", "java", "c"], "a\tb\n\u00e9"), (2, [], None)], "id int, langs array<string>, t string")
    writers.fan_out(df, F.col("langs"), str(tmp_path / "f"))
    assert sorted(r.lang for r in spark.read.json(str(tmp_path / "f")).collect()) == ["c", "java"]
    writers.tsv(df.select("id", "t"), str(tmp_path / "t"))
    assert "1\ta\\tb\\n\u00e9" in [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    writers.score_lines(df, ["id", "t"], "<S>", str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() >= 2
    assert writers.stats(df.agg(F.count("*").alias("n")), str(tmp_path / "j")) == {"n": 2}
    writers.split_failures(df.withColumn("why", F.when(F.col("id") == 2, "empty")), "why", str(tmp_path / "k"), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "k")).count() == spark.read.json(str(tmp_path / "x")).count() == 1
    writers.partitioned(df.select("id", F.lit("dd").alias("task")), ["task"], str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where("task = 'dd'").count() == 2
    for fmt in ("jsonl", "csv", "parquet"):
        writers.any_format(df.select("id", "t"), str(tmp_path / f"any-{fmt}"), fmt)
    assert writers.demo(df.withColumn("flag", F.lit(True)), "flag", "id").first()["id"] == 1


def test_stream(spark, tmp_path):
    from codeloom.streaming import events

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.by_window(events.stream(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "), 3), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.start, r.event_type): r.n for r in events.by_window(df, "1 hour").collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("w").collect()} == want


def test_lines_are_numbered_without_a_task_that_holds_a_file(spark, tmp_path):
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = [f"{i} \u00e9{'x' * (i % 13)}" if i % 17 else "" for i in range(500)]
    for part in range(2):  # a folder of two files goes on where the first ends
        (tmp_path / f"part-0000{part}").write_text("".join(x + ("\r\n" if i % 3 else "\n") for i, x in enumerate(lines[part * 300 :][: 300 - part * 100])), newline="")
    (tmp_path / "part-00002").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = readers.numbered(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
        whole = readers.numbered(spark, str(tmp_path), whole=True).collect()
        pairs = readers.parallel(spark, str(tmp_path), str(tmp_path), ("a", "b")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert len({r.task for r in got if r.file == "part-00000"}) > 3
    assert sorted((r.file, r.line, r.value) for r in got) == [(f"part-0000{i // 300}", i % 300, x) for i, x in enumerate(lines)]
    assert sorted((r.line, r.value) for r in whole) == list(enumerate(lines))
    assert sorted((r.a, r.b) for r in pairs) == sorted((x, x) for x in lines if x)
