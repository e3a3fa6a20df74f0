"""Readers and writers over whole tables: each query writes a table in one form and reads it back with the engine's reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import pairing, profile
from codeloom.plans.registry import query
from codeloom.session import cut, scratch
from codeloom.sources import readers, writers
from codeloom.sources.tables import table


def _one(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("_", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_", F.lit(1)), "_")
    return out.drop("_")


@query("""
with p as (select try_cast(payload as json) j from raw_records)
select count(*) n, count_if(j is null) corrupt, count_if(json_extract_string(j, '$.func') is not null) with_func, sum(try_cast(json_extract_string(j, '$.target') as int))::bigint targets, count(json_extract_string(j, '$.note')) notes from p""")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines read leniently, bad lines apart; the good ones written and read strictly."""
    lines, good_lines = scratch(spark), scratch(spark)
    table(spark, d, "raw_records").select(F.translate("payload", "\r\n", "  ").alias("value")).write.text(lines)
    schema = "func string, target int, project string, commit_id string, note string"
    good, bad = readers.jsonl_lenient(spark, lines, schema)
    writers.jsonl(good, good_lines)
    strict = readers.jsonl_strict(spark, good_lines, schema)
    sums = strict.agg(F.count("*").alias("good"), F.count("func").alias("with_func"), F.sum("target").alias("targets"), F.count("note").alias("notes"))
    return _one(sums, bad.agg(F.count("*").alias("corrupt"))).select((F.col("good") + F.col("corrupt")).alias("n"), "corrupt", "with_func", "targets", "notes")


@query("""
with c as (select case when lower(trim(split_name)) = 'test' then 'test' when lower(trim(split_name)) in ('train', 'training') then 'train' else 'valid' end split, count(*) n from cs where split_name is not null group by 1),
 o as (select split, n, case split when 'train' then 0 when 'valid' then 1 else 2 end s from c)
select split, n, n as distinct_keys, (sum(n) over (order by s) - n)::bigint first_key, (sum(n) over (order by s) - 1)::bigint last_key from o""")
def shard_index(spark: SparkSession, d: str) -> DataFrame:
    """Gzip shards of three splits with one continuous index."""
    root = scratch(spark)
    cs = table(spark, d, "cs").where("split_name is not null").select("url", "code", "split_name")
    name = F.lower(F.trim("split_name"))
    split = F.when(name == "test", "test").when(name.isin("train", "training"), "train").otherwise("valid")
    writers.partitioned(cs.select("url", "code", split.alias("part")), ["part"], root, "json")
    folders = {s: f"{root}/part={s}" for s in ("train", "valid", "test")}
    rows = readers.gz_shards(spark, {s: readers.shards(spark, p)[0] for s, p in folders.items()}, "url string, code string", "key")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("key").alias("distinct_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("""
with l as (select line, 'https://code.example/x/' || line url from split_index where split_name = 'test' union all select idx::int, url from (select distinct url, idx from cs)),
 m as (select url, max(coalesce(length(code), -1)) size from cs where url is not null group by url)
select line, l.url, size, case when m.url is null then 'missed' else 'found' end outcome from l left join m on m.url = l.url""")
def url_order_join(spark: SparkSession, d: str) -> DataFrame:
    """A list of urls joined to a map read from nested gzip folders, each line with its number and outcome."""
    root = scratch(spark)
    cs = table(spark, d, "cs")
    sized = cs.select("url", F.coalesce(F.length("code"), F.lit(-1)).alias("size"), F.coalesce("lang", F.lit("none")).alias("l"), F.col("idx").alias("k"))
    sized.withColumn("k", F.pmod("k", F.lit(3))).write.option("compression", "gzip").partitionBy("l", "k").json(root)
    known = readers.by_url(readers.recursive_jsonl(spark, root, "url string, size int")).withColumnRenamed("url", "u")
    listed = table(spark, d, "split_index").where("split_name = 'test'").select("line", F.concat(F.lit("https://code.example/x/"), "line").alias("url")).union(cs.select("url", "idx").distinct().select(F.col("idx").cast("int"), "url"))
    return listed.join(known, F.col("url") == F.col("u"), "left").select("line", "url", "size", F.when(F.col("u").isNull(), "missed").otherwise("found").alias("outcome"))


@query("""
with f as (select * from functions_raw where pos is not null)
select 'json' form, count(*) n, sum(coalesce(length(func), 0))::bigint size, sum(coalesce(target, 0))::bigint targets, count(project) projects from f
union all select 'jsonl', count(*), sum(coalesce(length(func), 0))::bigint, sum(coalesce(target, 0))::bigint, count(project) from f
union all select 'csv', count(*), sum(coalesce(length(func), 0))::bigint, sum(coalesce(target, 0))::bigint, count(nullif(project, '')) from f
union all select 'parquet', count(*), sum(coalesce(length(func), 0))::bigint, sum(coalesce(target, 0))::bigint, count(project) from f""")
def format_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One table written and read in four forms."""
    schema = "pos int, func string, target int, project string"
    f = table(spark, d, "functions_raw").where("pos is not null").select("pos", "func", "target", "project")
    read = {"json": readers.json_array, "jsonl": readers.jsonl_strict, "csv": readers.csv, "parquet": lambda s, p, _: readers.parquet(s, p, ["func", "target", "project", "absent"])}
    out = None
    for form, reader in read.items():
        path = scratch(spark)
        writers.any_format(f, path, form)
        sums = reader(spark, path, schema).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("func"), F.lit(0))).alias("size"), F.sum(F.coalesce("target", F.lit(0))).cast("long").alias("targets"), F.count(F.nullif("project", F.lit("")) if form == "csv" else "project").alias("projects"))
        sums = sums.select(F.lit(form).alias("form"), "*")
        out = sums if out is None else out.union(sums)
    return out


@query("""
with p as (select pos, coalesce(lower(lang), 'none') lang, path from function_meta)
select 'shard-' || (pos % 5) file, count(*) n, count(distinct lang) langs, sum(coalesce(length(path), 0))::bigint size from p group by 1""")
def files_apart(spark: SparkSession, d: str) -> DataFrame:
    """Parquet with zstd, one folder for each input file, read back file by file with the wanted columns only."""
    root = scratch(spark)
    m = table(spark, d, "function_meta").select("pos", F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), "path", F.concat(F.lit("shard-"), F.pmod("pos", F.lit(5))).alias("file"))
    writers.parquet_by_file(m, "file", root)
    out = None
    for folder in readers.shards(spark, f"{root}/file=shard-*"):
        part = readers.parquet(spark, folder, ["lang", "path"]).select(F.lit(folder.rpartition("=")[2]).alias("file"), "lang", "path")
        out = part if out is None else out.union(part)
    return out.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.sum(F.coalesce(F.length("path"), F.lit(0))).alias("size"))


@query("""
with f as (select pos, project, commit_id, pos % 10 = 3 bad from functions_raw where pos is not null), g as (select * from f where not bad and project is not null)
select (select count(*) from g) as kept, (select count(*) from f where bad) as wrong_arity,
 (select sum(len(list_filter(regexp_split_to_array(trim(project, ' '), '\\s+'), lambda x: x <> ''))) from g where project <> '')::bigint tokens, (select count(*) from f where not bad) - (select count(*) from g) as refused""")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tabs between fields under a header: lines with another number of fields apart, a field as words, a condition on rows."""
    root = scratch(spark)
    f = table(spark, d, "functions_raw").where("pos is not null")
    fields = ["pos", "project", "commit_id"]
    writers.tsv(f.where("pos % 10 <> 3").select("pos", F.when(F.col("project").isNull(), "<none>").otherwise(F.translate("project", "\t\n", "  ")).alias("project"), "commit_id"), f"{root}/good")
    writers.tsv(f.where("pos % 10 = 3").select("pos", F.lit("x").alias("project")), f"{root}/bad")
    spark.createDataFrame([("\t".join(fields),)], "value string").write.text(f"{root}/head")
    kept, wrong = readers.delimited(spark, f"{root}/*", "\t", fields, header=True, tokens=("project",), keep=F.col("project") != "<none>")
    every, _ = readers.delimited(spark, f"{root}/*", "\t", fields, header=True)
    sums = kept.agg(F.count("*").alias("kept"), F.sum(F.size("project")).alias("tokens"))
    return _one(sums, wrong.agg(F.count("*").alias("wrong_arity")), every.agg(F.count("*").alias("every"))).select("kept", "wrong_arity", "tokens", (F.col("every") - F.col("kept")).alias("refused"))


@query("""
with r as (select idx, any_value(url) url, any_value(coalesce(code, '')) code, any_value(coalesce(docstring_tokens, [])) t, any_value(coalesce(label, 0)) label from cs group by idx),
 c as (select *, regexp_replace(translate(code, chr(10)||chr(13), '  '), '[^\\x00-\\x7F]', '', 'g') a from r)
select count(*) n, count_if(idx % 2 = 0) scored, sum(length(a))::bigint size, sum(case when idx % 2 = 0 then idx % 100 end)::bigint scores from c""")
def split_mark_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of five fields, and of seven with scores, between marks, in ASCII."""
    root, mark = scratch(spark), "<CODESPLIT>"
    r = table(spark, d, "cs").groupBy("idx").agg(F.any_value("url").alias("url"), F.any_value(F.coalesce("code", F.lit(""))).alias("code"), F.any_value(F.coalesce("label", F.lit(0))).alias("label"))
    r = r.withColumn("code", F.translate("code", "\n\r", "  ")).withColumn("url_b", F.col("url")).withColumn("docstring", F.lit("d")).withColumn("logit0", F.lit(0)).withColumn("logit1", F.pmod("idx", F.lit(100)))
    five = ["label", "url", "url_b", "docstring", "code"]
    writers.score_lines(r.where("idx % 2 = 1"), five, mark, f"{root}/plain")
    writers.score_lines(r.where("idx % 2 = 0"), [*five, "logit0", "logit1"], mark, f"{root}/scored")
    plain, _ = readers.delimited(spark, f"{root}/*", mark, five)
    scored, _ = readers.delimited(spark, f"{root}/*", mark, [*five, "logit0", "logit1"])
    both = plain.select("code", F.lit(None).cast("long").alias("s")).union(scored.select("code", F.col("logit1").cast("long")))
    return both.agg(F.count("*").alias("n"), F.count("s").alias("scored"), F.sum(F.length("code")).alias("size"), F.sum("s").alias("scores"))


@query("""
with v as (select pos, case when pos % 11 = 0 then pos::varchar when pos % 11 = 1 then 'a b c d' when pos % 11 = 2 then 'a b x' else '  ' || pos || ' ' || (pos * 7) || chr(9) || coalesce(target, -1) || ' ' end l from functions_raw where pos is not null),
 i as (select try_cast(nullif(regexp_extract(value, '^\\s*([+-]?\\d+)\\s*$', 1), '') as bigint) x from split_index)
select count_if(pos % 11 > 2) as triples, count_if(pos % 11 <= 2) as refused, (select sum(coalesce(target, -1)) from functions_raw where pos % 11 > 2)::bigint labels, (select count(x) from i) as numbers, (select sum(x) from i)::bigint number_sum from v""")
def line_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three fields, lines with more or fewer refused; index files of whole numbers."""
    pairs, index = scratch(spark), scratch(spark)
    k = F.pmod("pos", F.lit(11))
    line = F.when(k == 0, F.col("pos").cast("string")).when(k == 1, "a b c d").when(k == 2, "a b x").otherwise(F.concat(F.lit("  "), "pos", F.lit(" "), F.col("pos") * 7, F.lit("\t"), F.coalesce("target", F.lit(-1)), F.lit(" ")))
    table(spark, d, "functions_raw").where("pos is not null").select(line.alias("value")).write.text(pairs)
    table(spark, d, "split_index").select(F.translate(F.coalesce("value", F.lit("")), "\n\r", "  ").alias("value")).write.text(index)
    good, bad = readers.triples(spark, pairs)
    numbers = readers.int_lines(spark, index)
    return _one(good.agg(F.count("*").alias("triples"), F.sum("label").alias("labels")), bad.agg(F.count("*").alias("refused")), numbers.agg(F.count("*").alias("numbers"), F.sum("value").alias("number_sum")))


@query("""
with f as (select pos, trim(regexp_replace(func, '\\s+', ' ', 'g'), ' ') s, target, coalesce(project, '') p from functions_raw where func is not null and length(trim(regexp_replace(func, '\\s+', ' ', 'g'), ' ')) > 0),
 c as (select trim(regexp_replace(array_to_string(list_transform(list_filter(docstring_tokens, lambda x: x is not null), lambda x: x), ' '), '\\s+', ' ', 'g'), ' ') d, trim(regexp_replace(coalesce(code, ''), '\\s+', ' ', 'g'), ' ') c from (select any_value(coalesce(docstring_tokens, [])) docstring_tokens, any_value(code) code from cs group by idx)),
 p as (select a.s || ' ' || b.s s, a.target t from f a join f b on b.pos = a.pos + 1)
select 'defect' task, count(*) n, sum(length(s))::bigint source, sum(length(coalesce(target::varchar, '')))::bigint target from f
union all select 'refine', count(*), sum(length(s))::bigint, sum(length(s) + 2)::bigint from f
union all select 'translate', count(*), sum(length(s))::bigint, sum(length(s))::bigint from f
union all select 'concode', count(*), sum(length(s))::bigint, sum(length(s))::bigint from f
union all select 'clone', count(*), sum(length(s))::bigint, sum(length(coalesce(t, 0)::varchar))::bigint from p
union all select 'search', count(*), sum(length(d))::bigint, sum(length(c))::bigint from c
union all select 'summarize', count(*), sum(length(c))::bigint, sum(length(d))::bigint from c""")
def task_examples(spark: SparkSession, d: str) -> DataFrame:
    """Files of seven tasks, found by name and read in one form of source and target."""
    from codeloom.functions.text import squeeze

    root = scratch(spark)
    # squeezed once; the files are compressed, as the tasks hold each text nine times
    f = cut(table(spark, d, "functions_raw").where("func is not null").select("pos", squeeze(F.col("func")).alias("s"), "target").where("length(s) > 0"))
    c = cut(table(spark, d, "cs").groupBy("idx").agg(F.any_value(F.coalesce("docstring_tokens", F.array().cast("array<string>"))).alias("t"), F.any_value(F.coalesce("code", F.lit(""))).alias("c")))
    t = F.filter("t", lambda x: x.isNotNull())
    names = {"lang": "c", "size": "small"}
    path = lambda task, i=0: readers.file_names(f"{root}/{task}", task, "train", **names)[i]
    lines = lambda df, to: writers.jsonl(df, to, compression="gzip")
    lines(f.select(F.col("pos").alias("idx"), F.col("s").alias("func"), "target"), path("defect"))
    # both sides are scans of one table, so their files have its rows in one order
    for task, other in (("refine", F.concat("s", F.lit(" ;"))), ("translate", F.col("s"))):
        for i, side in enumerate((F.col("s"), other)):
            f.select(side.alias("value")).write.option("compression", "gzip").text(path(task, i))
    lines(f.select(F.col("s").alias("nl"), F.col("s").alias("code")), path("concode"))
    lines(f.select(F.col("pos").cast("string").alias("idx"), F.col("s").alias("func")), f"{root}/clone/data.jsonl")
    f.select(F.concat_ws(" ", F.col("pos"), F.col("pos") + 1, F.coalesce("target", F.lit(0))).alias("value")).write.option("compression", "gzip").text(path("clone"))
    lines(c.select(t.alias("docstring_tokens"), F.col("c").alias("code")), path("search"))
    lines(c.select(F.array("c").alias("code_tokens"), t.alias("docstring_tokens")), path("summarize"))
    out = None
    for task in readers.FILES:
        rows = readers.read_examples(spark, f"{root}/{task}", task, "train", **names)
        sums = rows.agg(F.count("*").alias("n"), F.sum(F.length("source")).alias("source"), F.sum(F.length(F.coalesce("target", F.lit("")))).alias("target")).select(F.lit(task).alias("task"), "*")
        out = sums if out is None else out.union(sums)
    return out


@query("""
with a as (select lower(trim(p.poisoned::varchar)) flag, (id % 4) m, pred = label hit from prediction p where pred is not null and label is not null)
select 'task-' || (m % 2) task, 'model-' || m model, count(*) seen, round(avg(hit::int), 2) mean from a group by m""")
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Results in nested folders of task and model, their nested numbers averaged; summaries of a glob."""
    root = scratch(spark)
    p = table(spark, d, "prediction").where("pred is not null and label is not null")
    for m in range(4):
        part = p.where(F.pmod("id", F.lit(4)) == m).agg(F.count("*").alias("seen"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("acc"))
        writers.stats(part.select(F.struct("seen", "acc").alias("metrics")), f"{root}/task-{m % 2}/model-{m}/result.json")
    paths = [p.rpartition("/")[0] for p in readers.shards(spark, f"{root}/*/*/*/part-*")]
    assert len(paths) == 4
    rows = readers.nested_results(spark, root, "metrics struct<seen: long, acc: double>", ["task", "model", "result", "part"])
    return profile.nested_means(rows, ["task", "model"], {"seen": "metrics.seen", "mean": "metrics.acc"}).select("task", "model", F.col("seen").cast("long").alias("seen"), "mean")


@query("""
with b as (select project nm, commit_id tid, pos::varchar pid, pos from functions_raw), k as (select nm k, 0 o, pos from b where nm is not null union all select tid, 1, pos from b where tid is not null union all select pid, 2, pos from b),
 m as (select k, first(pos order by o, pos) pos from k group by k), q as (select distinct project k from functions_raw where project is not null union all select pos::varchar from functions_raw union all select 'none-' || line from split_index where split_name = 'test')
select count(*) asked, count(m.pos) known, sum(m.pos)::bigint rows_sum from q left join m using (k)""")
def dataset_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a dataset found by name, task id or problem id, whichever is known."""
    f = table(spark, d, "functions_raw")
    known = readers.by_any_name(f.select("pos", F.col("project").alias("nm"), F.col("commit_id").alias("tid"), F.col("pos").cast("string").alias("pid")), ["nm", "tid", "pid"], "k").select("k", "pos")
    asked = f.where("project is not null").select(F.col("project").alias("k")).distinct().union(f.select(F.col("pos").cast("string"))).union(table(spark, d, "split_index").where("split_name = 'test'").select(F.concat(F.lit("none-"), "line")))
    return asked.join(known, "k", "left").agg(F.count("*").alias("asked"), F.count("pos").alias("known"), F.sum("pos").alias("rows_sum"))


@query("""
with a as (select f.project, list(distinct lower(m.lang)) langs from functions_raw f join function_meta m using (pos) where project is not null group by project)
select l lang, count(*) projects, sum(len(list_filter(langs, lambda x: x is not null)))::bigint in_all from (select project, langs, unnest(langs) l from a) where l is not null group by l""")
def language_fanout(spark: SparkSession, d: str) -> DataFrame:
    """A project's whole row goes to the folder of every language it holds, and comes back from there (K4)."""
    root = scratch(spark)
    joined = table(spark, d, "functions_raw").select("pos", "project").where("project is not null").join(table(spark, d, "function_meta").select("pos", F.lower("lang").alias("l")), "pos")
    arrays = joined.groupBy("project").agg(F.collect_set("l").alias("langs"))  # at most one entry a language
    writers.fan_out(arrays.where(F.size("langs") > 0), F.col("langs"), root, "parquet")
    return spark.read.parquet(root).groupBy("lang").agg(F.count("*").alias("projects"), F.sum(F.size("langs")).alias("in_all"))


@query("""
with r as (select pos, case when func is null then 'missing' when trim(translate(func, chr(9)||chr(10)||chr(13), '   ')) = '' then 'blank' when length(func) < 10 then 'too_short' when length(func) > 10000 then 'too_long' end reason from functions_raw)
select coalesce(reason, 'kept') place, count(*) n, sum(pos)::bigint keys from r group by 1""")
def failure_files(spark: SparkSession, d: str) -> DataFrame:
    """Kept rows in one place, refused ones with their reason in another (K8)."""
    from codeloom.operators import quality

    kept, failed = scratch(spark), scratch(spark)
    f = table(spark, d, "functions_raw").select("pos", "func")
    writers.split_failures(f.withColumn("reason", F.nullif(quality.code_reason(F.col("func")), F.lit("valid"))).select("pos", "reason"), "reason", kept, failed)
    both = readers.jsonl_strict(spark, kept, "pos int").select("pos", F.lit("kept").alias("place")).union(readers.jsonl_strict(spark, failed, "pos int, reason string").select("pos", "reason"))
    return both.groupBy("place").agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with u as (select idx, min(url) url from cs group by idx) select (select min(idx) from cs where poisoned) as first_flagged, (select count(*) from u) as queries, (select count(*) from u) * 2 as batch_rows""")
def query_batches(spark: SparkSession, d: str) -> DataFrame:
    """Every query's batch in a place of its own, with its metadata, and the first flagged row to look at."""
    root = scratch(spark)
    cs = table(spark, d, "cs")
    pool = cs.select("idx").distinct()
    pairs = pairing.candidate_batches(pool, pool, "idx", 2, "b")
    writers.by_query(pairs.withColumn("shelf", F.pmod("query_key", F.lit(16))), "shelf", root, form="candidates")
    back = spark.read.json(f"{root}/batches").agg(F.count_distinct("query_key").alias("queries"), F.count("*").alias("batch_rows"))
    told = spark.read.json(f"{root}/metadata").select("rows", "form")
    return _one(writers.demo(cs, "poisoned", "idx").select(F.col("idx").alias("first_flagged")), back.join(told, (F.col("rows") == F.col("batch_rows")) & (F.col("form") == "candidates")).drop("rows", "form"))


@query("""
with w as (select lower(t) w from (select unnest(docstring_tokens) t from cs) where t is not null), k as (select w word, count(*) n from w where regexp_matches(w, '^[a-z]+$') group by w)
select word, n, row_number() over (order by n desc, word) - 1 place from k""")
def frequency_file(spark: SparkSession, d: str) -> DataFrame:
    """Word frequencies written as sorted lines, and read back in the order of the file."""
    root = scratch(spark)
    words = F.filter(F.transform(F.filter("docstring_tokens", lambda x: x.isNotNull()), F.lower), lambda w: w.rlike("^[a-z]+$"))
    writers.frequency_tsv(profile.frequencies(table(spark, d, "cs"), words), "word", "n", root)
    at = 0
    out = None
    for part in readers.shards(spark, f"{root}/part-*"):  # files in the order of their names; a file a task of the sort
        lines = readers.numbered(spark, part)
        n = lines.count()
        p = F.split("value", "\t")
        rows = lines.select(p[0].alias("word"), p[1].cast("long").alias("n"), (F.col("line") + at).cast("long").alias("place"))
        out, at = rows if out is None else out.union(rows), at + n
    return out


@query("""
select count(*) lines, sum(length(l))::bigint size, 12 as shards from (select 'v' || pos || ':' || coalesce(project, '') l from functions_raw where pos is not null)""")
def shard_concat(spark: SparkSession, d: str) -> DataFrame:
    """Shards of lines put together in the order of their numbers."""
    root, whole = scratch(spark), scratch(spark)
    f = table(spark, d, "functions_raw").where("pos is not null").select(F.concat(F.lit("v"), "pos", F.lit(":"), F.translate(F.coalesce("project", F.lit("")), "\n\r", "  ")).alias("value"), F.pmod("pos", F.lit(12)).alias("shard"))
    f.write.partitionBy("shard").text(root)
    folders = [x for x in readers.shards(spark, f"{root}/shard=*")]
    writers.concatenated(spark, folders, whole)
    return spark.read.text(whole).agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("size"), F.lit(len(folders)).alias("shards"))
