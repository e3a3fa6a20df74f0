"""Text expressions and score algebra over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scores, text, udfs
from codeloom.plans.registry import query
from codeloom.sources.tables import table


@query("""
with t as (select trim(regexp_replace(func, '\\s+', ' ', 'g'), ' ') a, translate(func, chr(32)||chr(9)||chr(10)||chr(13), '') b, func from functions_raw where func is not null)
select sum(length(a))::bigint squeezed, sum(length(b))::bigint bare, sum(len(regexp_extract_all(func, '[A-Za-z_]\\w*|\\d+|[^\\s]')))::bigint tokens, count_if(a = func) unchanged from t""")
def whitespace_forms(spark: SparkSession, d: str) -> DataFrame:
    """White space squeezed and removed, approximate tokens, outputs compared."""
    f = table(spark, d, "functions_raw").where("func is not null").select("func", text.squeeze(F.col("func")).alias("a"), text.no_space(F.col("func")).alias("b"))
    return f.agg(F.sum(F.length("a")).alias("squeezed"), F.sum(F.length("b")).alias("bare"), F.sum(text.approx_tokens(F.col("func"))).alias("tokens"), F.count_if(F.expr("a = func")).alias("unchanged"))


@query("""
select pos, len(regexp_extract_all(func, '[A-Za-z_]\\w*|\\d+|[^\\s]'))::bigint tokens from functions_raw where func is not null order by tokens, pos limit 50""")
def shortest_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by approximate token count."""
    f = table(spark, d, "functions_raw").where("func is not null").select("pos", text.approx_tokens(F.col("func")).cast("long").alias("tokens"))
    return f.orderBy("tokens", "pos").limit(50)


@query("""
with t as (select pos, case when pos % 3 = 0 then 'x [Answer] ' || func when pos % 3 = 1 then 'y [Answer] ```c' || chr(10) || func || '```' else func end s from functions_raw where func is not null and not contains(func, '```')),
 m as (select pos, string_split(s, '[Answer]') p, s from t)
select pos % 3 form, count(*) n, sum(length(trim(case when len(p) = 1 then s else coalesce(nullif(regexp_extract(p[-1], '(?s)```[A-Za-z+]*\\n(.*?)```', 1), ''), p[-1]) end, chr(32)||chr(10)||chr(9))))::bigint size from m group by 1""")
def marked_extract(spark: SparkSession, d: str) -> DataFrame:
    """What follows a marker, fenced or not."""
    f = table(spark, d, "functions_raw").where("func is not null and not contains(func, '```')")
    s = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("x [Answer] "), "func")).when(F.col("pos") % 3 == 1, F.concat(F.lit("y [Answer] ```c\n"), "func", F.lit("```"))).otherwise(F.col("func"))
    return f.select((F.col("pos") % 3).alias("form"), F.length(text.marked(s, "[Answer]")).alias("k")).groupBy("form").agg(F.count("*").alias("n"), F.sum("k").alias("size"))


@query("""
with c as (select pos, coalesce(commit_id, '') s from functions_raw) select pos, list_reduce(list_prepend(2166136261::ubigint, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::ubigint)), lambda a, b: ((xor(a, b)) * 16777619::ubigint) % 4294967296::ubigint)::bigint h from c where regexp_matches(s, '^[ -~]*\\z')""")
def fnv1a_hash(spark: SparkSession, d: str) -> DataFrame:
    """32-bit FNV-1a."""
    c = table(spark, d, "functions_raw").select("pos", F.coalesce("commit_id", F.lit("")).alias("s")).where(F.col("s").rlike(r"^[ -~]*\z"))
    return c.select("pos", text.fnv1a(F.col("s")).alias("h"))


@query("""
with v as (select case when l_linenumber = 1 then null when l_linenumber = 2 then 'x' else (l_partkey * 7 % 5000)::varchar end ms from lineitem) select (case when try_cast(ms as bigint) is null then 6 else greatest(1, ceil(try_cast(ms as bigint) / 1000.0)) end)::int s, count(*) n from v group by 1""")
def timeout_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds to whole seconds with a default."""
    ms = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_linenumber") == 2, "x").otherwise((F.col("l_partkey") * 7 % 5000).cast("string"))
    return table(spark, d, "lineitem").groupBy(text.seconds(ms).alias("s")).agg(F.count("*").alias("n"))


@query("""
with t as (select func s, case when length(func) > 400 then substr(func, 1, 400) || '[cut]' else func end c, replace(replace(func, chr(13), '\\r'), chr(10), '\\n') e, case when starts_with(ltrim(func), '<?php') then func else '<?php' || chr(10) || func || chr(10) || '?>' end p from functions_raw where func is not null)
select sum(length(c))::bigint cut, sum(length(e))::bigint escaped, count_if(contains(e, chr(10))) broken, sum(length(p))::bigint wrapped from t""")
def truncate_escape_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Cut with a mark, line breaks escaped, wrapped."""
    f = table(spark, d, "functions_raw").where("func is not null").select(text.truncate(F.col("func"), 400, "[cut]").alias("c"), text.escape_lines(F.col("func")).alias("e"), text.php_wrap(F.col("func")).alias("p"))
    return f.agg(F.sum(F.length("c")).alias("cut"), F.sum(F.length("e")).alias("escaped"), F.count_if(F.contains("e", F.lit("\n"))).alias("broken"), F.sum(F.length("p")).alias("wrapped"))


@query("""
with t as (select idx, list_filter(docstring_tokens, lambda x: x is not null) a, regexp_extract_all(code, '\\w+') b from cs where code is not null and docstring_tokens is not null),
 k as (select len(a) na, len(b) nb from t), p as (select case when na + nb <= 64 then na when na <= 32 then na when nb <= 32 then 64 - nb else 32 end ka, case when na + nb <= 64 then nb when nb <= 32 then nb when na <= 32 then 64 - na else 32 end kb from k)
select sum(ka)::bigint a, sum(kb)::bigint b, max(ka + kb)::bigint most from p""")
def pair_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Two token lists cut to one budget."""
    cs = table(spark, d, "cs").where("code is not null and docstring_tokens is not null")
    p = text.pair_budget(F.filter("docstring_tokens", lambda x: x.isNotNull()), F.regexp_extract_all("code", F.lit(r"\w+"), F.lit(0)), 64)
    sizes = cs.select(p.alias("p")).select(F.size("p.a").alias("a"), F.size("p.b").alias("b"))
    return sizes.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max(F.col("a") + F.col("b")).cast("long").alias("most"))


_SCORES_SQL = """e as (select vec_id, list_transform(embedding[1:4], lambda x: x::double) s, list_transform(embedding[5:8], lambda x: abs(x::double)) v from embeddings),
 w as (select vec_id, s, v, list_transform(s, lambda x: exp(x - list_max(s))) ex from e), p as (select vec_id, s, v, list_transform(ex, lambda x: x / list_sum(ex)) p from w)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    cast = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", cast(1, 4).alias("s"), F.transform(cast(5, 4), F.abs).alias("v"))


@query(f"""
with {_SCORES_SQL} select vec_id, round(list_sum(list_transform(range(1, 5), lambda i: p[i] * v[i])), 6) weighted, list_position(s, list_max(s)) - 1 best, (len(list_filter(v, lambda x: x > 0.1)) >= 2)::int vote,
 round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) entropy from p""")
def weighted_inference(spark: SparkSession, d: str) -> DataFrame:
    """Softmax-weighted value, first best candidate, majority vote, entropy."""
    s = _scores(spark, d)
    votes = F.transform("v", lambda x: (x > 0.1).cast("int"))
    return s.select("vec_id", F.round(scores.weighted(F.col("s"), F.col("v")), 6).alias("weighted"), scores.argmax(F.col("s")).cast("long").alias("best"), scores.majority(votes).alias("vote"), F.round(scores.entropy(scores.softmax(F.col("s"))), 6).alias("entropy"))


@query(f"""
with {_SCORES_SQL} select vec_id, round(list_sum(list_transform(range(0, 16), lambda k: case when k // 4 < k % 4 then greatest(0.0, s[k // 4 + 1] - s[k % 4 + 1] + (k % 4 - k // 4) * 0.05) else 0.0 end)), 6) loss, round(s[1] / greatest(3, 1), 6) per_token from p""")
def ranking_loss(spark: SparkSession, d: str) -> DataFrame:
    """Hinge loss over ordered candidates, length-normalised score."""
    return _scores(spark, d).select("vec_id", F.round(scores.hinge(F.col("s"), 0.05), 6).alias("loss"), F.round(scores.per_token(F.col("s")[0], F.lit(3)), 6).alias("per_token"))


@query("""
with t as (select pos, func, list_filter(string_split(regexp_replace(func, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') w from functions_raw where func is not null),
 x as (select pos, w, unnest(range(1, len(w) + 1)) i from t), y as (select pos, i, w[i] tok, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') s, array_to_string(w, ' ') whole from x),
 z as (select pos, i, tok, (('0x' || substr(md5('lm:' || whole), 1, 8))::bigint % 1000 - ('0x' || substr(md5('lm:' || s), 1, 8))::bigint % 1000) / 100.0::double sus from y),
 g as (select pos, round(max(sus), 6) most, count(*) n, count_if(not (sus >= 5 and abs(sus) > 1e-5)) kept, string_agg(tok, ' ' order by i) filter (where not (sus >= 5 and abs(sus) > 1e-5)) p from z group by pos)
select pos, most, kept, case when kept = n then func else coalesce(p, '') end purified from g join t using (pos)""")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each token's effect on a score, over all tokens of the whole text, and the text without those that reach the bar."""
    words = F.filter(F.split(F.regexp_replace("func", r"\s+", " "), " "), lambda x: x != "")
    t = table(spark, d, "functions_raw").where(F.col("func").rlike(r"\S")).select("pos", "func")
    # work grows with the square of a text, so rows spread over all cores also where the table is small
    t = t.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "pos")
    t = t.withColumn("whole", F.array_join(words, " ")).withColumn("h", udfs.hashes_and_without_each(F.lit("lm"), F.col("whole")))
    sus = F.transform(F.slice("h", 2, F.size("h")), lambda h: (F.pmod(F.col("h")[0], F.lit(1000)) - F.pmod(h, F.lit(1000))) / 100.0)
    s = t.select("pos", "func", F.split("whole", " ").alias("w"), sus.alias("sus"))
    kept = F.size(F.filter("sus", lambda x: ~((x >= 5) & (F.abs(x) > 1e-5)))).cast("long")
    return s.select("pos", F.round(F.array_max("sus"), 6).alias("most"), kept.alias("kept"), scores.purify(F.col("func"), F.col("w"), F.col("sus"), F.lit(5)).alias("purified"))
